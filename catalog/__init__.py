"""Registered queries over the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

MODULES = ("vectors", "words", "prompts", "records", "files", "stores")


def load() -> tuple[dict, dict]:
    """All queries and all oracle SQL."""
    from . import base

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return base.QUERIES, base.ORACLE
