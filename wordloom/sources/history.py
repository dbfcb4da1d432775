"""Prompt history: scan, decode, append with first-write-wins, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

COMPONENT_MAP = "map<string,array<string>>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All prompts; tables written before favourites existed read as not favoured."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if "favorited" not in df.columns:
        df = df.withColumn("favorited", F.lit(False))
    return df.withColumn("favorited", F.coalesce(F.col("favorited").cast("boolean"), F.lit(False)))


def decode(rows: DataFrame) -> DataFrame:
    """Stored row -> typed row: JSON text to map, 0/1 to boolean, ISO text to timestamp."""
    return rows.withColumns(
        {
            "components": F.from_json("components", COMPONENT_MAP),
            "favorited": F.col("favorited").cast("boolean"),
            "created_at": F.col("created_at").cast("timestamp_ntz"),
        }
    )


def encode(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "components": F.to_json("components"),
            "favorited": F.col("favorited").cast("int"),
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        }
    )


def first_writes(prompts: DataFrame, order: str = "id") -> DataFrame:
    """One row per hash: the first written.  Map-side combined, so a hot hash is one row per task."""
    cols = [c for c in prompts.columns if c != "hash"]
    kept = prompts.groupBy("hash").agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return kept.select("hash", *[F.col(f"_r.{c}").alias(c) for c in cols])


def unseen(prompts: DataFrame, history: DataFrame) -> DataFrame:
    return prompts.join(history.select("hash"), "hash", "left_anti")


SMALL_BATCH = 1_000_000  # hashes of a batch that is counted to be this small are shipped to the history's tasks


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def append_new(prompts: DataFrame, path: str, order: str = "id", small_batch: int = SMALL_BATCH) -> DataFrame:
    """Insert-or-ignore on the hash: the first write of a batch, unless history has the hash.  Returns what was stored.

    An anti join would shuffle the whole history for every batch.  So the hashes of a small batch go to the
    history first, which is then only scanned; what they hit there is as small as the batch.
    """
    spark = prompts.sparkSession
    new = cut(first_writes(prompts, order))
    old = existing(spark, path)
    if old is not None:
        hashes = new.select("hash")
        if new.count() <= small_batch:
            old = old.select("hash").join(F.broadcast(hashes), "hash", "left_semi")
        new = cut(unseen(new, old))
    new = new.select(*prompts.columns)
    new.write.mode("append").parquet(path)
    return new


def export_order(favorites_only: bool) -> Column:
    return F.desc("id") if favorites_only else F.asc("id")


def export_json(history: DataFrame, path: str, favorites_only: bool = False) -> None:
    """JSON Lines in id order (all) or newest first (favourites only)."""
    rows = history.filter("favorited") if favorites_only else history
    rows.orderBy(export_order(favorites_only)).write.mode("overwrite").json(path)


def export_text(prompts: DataFrame, path: str) -> None:
    prompts.select("positive").write.mode("overwrite").text(path)
