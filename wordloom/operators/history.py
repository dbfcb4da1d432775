"""Analytics over the prompt history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MILESTONES, coverage_percent, log_progress, progress_cells
from ..sources.history import first_writes
from .ordered import CHUNK_ROWS, dense_index, last_before


def recent(history: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; a top-n per task, then a merge."""
    return history.orderBy(F.desc("id")).limit(limit)


def favorites(history: DataFrame) -> DataFrame:
    return history.filter("favorited").orderBy(F.desc("id"))


def favorite_hashes(history: DataFrame) -> DataFrame:
    return history.filter("favorited").select("hash")


def seen_hashes(history: DataFrame) -> DataFrame:
    return history.select("hash").distinct()


def summary(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("favorited").alias("favorites"),
        F.count_distinct("template_id").alias("templates_used"),
        F.min("created_at").alias("first_generated"),
        F.max("created_at").alias("last_generated"),
    )


def by_template(history: DataFrame) -> DataFrame:
    return history.groupBy("template_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "template_id")


def coverage(history: DataFrame, total: int) -> DataFrame:
    """Distinct prompts against the size of the space: percent, log progress, cells of a 32-cell bar."""
    n = history.agg(F.count_distinct("hash").alias("count"))
    t = F.lit(str(total)).cast("decimal(38,0)")
    p = log_progress(F.col("count"), t)
    return n.select("count", coverage_percent(F.col("count"), t).alias("percent"), p.alias("progress"), progress_cells(p).alias("cells"))


def milestones(history: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The prompts at which the number of distinct prompts reached a milestone."""
    kept = first_writes(history.select("hash", "id", "template_id"), "id")
    numbered = dense_index(kept, [], "id", "count", chunk_rows)
    return numbered.filter(F.col("count").isin(*MILESTONES)).select("count", "id", "hash", "template_id")


def template_switches(history: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with ``template_changed``: the template differs from the one before (the first row changes)."""
    prev = last_before(history.select("id", "template_id"), [], "id", ["template_id"], chunk_rows=chunk_rows)
    changed = ~F.col("template_id").eqNullSafe(F.col("before_template_id"))
    return prev.select("id", "template_id", changed.alias("template_changed"))


def toggles(events: DataFrame) -> DataFrame:
    """Favourite state per hash from an append-only table of toggles: odd counts are favoured."""
    return events.groupBy("hash").agg((F.count(F.lit(1)) % 2 == 1).alias("favorited"))


def apply_toggles(history: DataFrame, events: DataFrame) -> DataFrame:
    """History with toggles applied; toggles of unknown hashes change nothing."""
    t = toggles(events).withColumnRenamed("favorited", "_flip")
    out = history.join(t, "hash", "left")
    return out.withColumn("favorited", F.col("favorited") != F.coalesce("_flip", F.lit(False))).select(*history.columns)


def with_favorites(history: DataFrame, hashes: DataFrame) -> DataFrame:
    marks = hashes.select("hash").distinct().withColumn("_f", F.lit(True))
    return history.join(marks, "hash", "left").withColumn("is_favorite", F.col("_f").isNotNull()).drop("_f")
