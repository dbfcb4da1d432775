"""Named result tables of a pipeline, one folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write every table of a report under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
