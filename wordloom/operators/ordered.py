"""Ordered scans that hold for hot keys: running totals, carried values, dense numbering.

A plain window would put all rows of a key into one task.  Here the rows are dealt into ranges of the order
column, of any type that sorts; windows run per (key, range), and one row per (key, range) carries the state
across ranges.  Below ``CHUNK_ROWS`` rows there is one range, and the plan is the plain window.

The order column must be unique within a key (an id): rows with equal values share a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK_ROWS = 1_000_000


def with_chunks(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """Add ``_chunk``, non-decreasing in ``order``: ranges of about ``chunk_rows`` rows, as many as that takes.

    The dealt rows are cut, so that all that follows sees the same ranges and the input is not computed again.
    """
    n = max(1, math.ceil(df.count() / chunk_rows))
    if n == 1:
        return df.withColumn("_chunk", F.lit(0)), 1
    return cut(df.repartitionByRange(n, F.col(order)).withColumn("_chunk", F.spark_partition_id())), n


def _across(by: list[str]):
    return Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def dense_index(df: DataFrame, by: list[str], order: str, name: str = "index", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1, 2, 3, ... per key in the given order."""
    df, n = with_chunks(df, order, chunk_rows)
    local = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(order)).cast("bigint")
    if n == 1:
        return df.withColumn(name, local).drop("_chunk")
    # at most one row per (key, chunk)
    sizes = df.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(*by, "_chunk", F.coalesce(F.sum("_n").over(_across(by)), F.lit(0)).alias("_off"))
    return df.join(offs, [*by, "_chunk"]).withColumn(name, local + F.col("_off")).drop("_chunk", "_off")


def running_sum(df: DataFrame, by: list[str], order: str, sums: dict[str, str], inclusive: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running totals per key: ``sums`` maps a new column to the column it adds up."""
    df, n = with_chunks(df, order, chunk_rows)
    w = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    if n == 1:
        return df.withColumns({k: F.coalesce(F.sum(c).over(w), zero) for k, c in sums.items()}).drop("_chunk")
    parts = df.groupBy(*by, "_chunk").agg(*[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    offs = parts.select(*by, "_chunk", *[F.coalesce(F.sum(f"_s_{k}").over(_across(by)), zero).alias(f"_off_{k}") for k in sums])
    out = df.join(offs, [*by, "_chunk"])
    out = out.withColumns({k: F.coalesce(F.sum(c).over(w), zero) + F.col(f"_off_{k}") for k, c in sums.items()})
    return out.drop("_chunk", *[f"_off_{k}" for k in sums])


def last_before(df: DataFrame, by: list[str], order: str, cols: list[str], prefix: str = "before_", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per column the last non-null value of an earlier row of the key."""
    df, n = with_chunks(df, order, chunk_rows)
    w = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    if n == 1:
        return df.withColumns({prefix + c: e for c, e in local.items()}).drop("_chunk")
    parts = df.groupBy(*by, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in cols]
    )
    carry = parts.select(*by, "_chunk", *[F.last(f"_l_{c}", ignorenulls=True).over(_across(by)).alias(f"_c_{c}") for c in cols])
    out = df.join(carry, [*by, "_chunk"])
    out = out.withColumns({prefix + c: F.coalesce(e, F.col(f"_c_{c}")) for c, e in local.items()})
    return out.drop("_chunk", *[f"_c_{c}" for c in cols])
