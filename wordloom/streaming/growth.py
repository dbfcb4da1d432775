"""Incremental pool growth: raw lines in, new (category, term) pairs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_lines


def grow(texts: DataFrame) -> DataFrame:
    """New terms of a stream of (category, text).  The stream's checkpoint is the resume point."""
    lines = texts.select("category", F.explode(term_lines(F.col("text"))).alias("term"))
    return lines.dropDuplicates(["category", "term"])
