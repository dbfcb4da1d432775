"""Vector tables: scans of keyed archives, the compute-once cache, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def split_keys(entries: DataFrame) -> DataFrame:
    """(key ``category/word/space``, vector) -> (category, word, space, vector, load order).

    The space is what follows the last slash, the category what precedes the first; words may hold
    slashes.  Keys that start with an underscore are metadata.
    """
    k = F.col("key")
    return entries.filter(~k.startswith("_") & k.rlike("^[^/]*/.*/[^/]+$")).select(
        F.regexp_extract(k, "^([^/]*)/", 1).alias("category"),
        F.regexp_extract(k, "^[^/]*/(.*)/[^/]+$", 1).alias("word"),
        F.regexp_extract(k, "/([^/]+)$", 1).alias("space"),
        "vector",
        "ordinal",
    )


def by_category(entries: DataFrame, visual: str = "clip", semantic: str = "t5") -> DataFrame:
    """Archive entries as one row per (category, word) with both vectors."""
    parts = split_keys(entries)
    pick = lambda s: F.max_by("vector", F.when(F.col("space") == s, F.col("ordinal")))
    return parts.groupBy("category", "word").agg(
        F.min("ordinal").alias("ordinal"), pick(visual).alias("visual"), pick(semantic).alias("semantic")
    )


def word_vectors(entries: DataFrame, space: str = "clip") -> DataFrame:
    """One space only: the vector of each word, last entry wins; entries without a vector are skipped."""
    parts = split_keys(entries).filter((F.col("space") == space) & (F.size("vector") > 0))
    return parts.groupBy("word").agg(F.max_by("vector", "ordinal").alias("vector"))


def by_space(entries: DataFrame, visual: str = "clip", semantic: str = "t5") -> DataFrame:
    """The second archive layout, ``space/word``, as one row per word."""
    k = F.col("key")
    parts = entries.filter(k.rlike(f"^({visual}|{semantic})/")).select(
        F.regexp_extract(k, "^([^/]+)/", 1).alias("space"),
        F.regexp_extract(k, "^[^/]+/(.*)$", 1).alias("word"), "vector", "ordinal",
    )
    pick = lambda s: F.max_by("vector", F.when(F.col("space") == s, F.col("ordinal")))
    return parts.groupBy("word").agg(pick(visual).alias("visual"), pick(semantic).alias("semantic"))


def attach(words: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """Words with their vectors.  ``strict`` raises when a word has none."""
    if strict:
        gone = missing(words, vectors).limit(1).collect()
        if gone:
            raise KeyError(f"no vector for {gone[0]['word']!r}")
    return words.join(vectors, "word")


def missing(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct words that have no vector yet."""
    return words.select("word").distinct().join(vectors.select("word"), "word", "left_anti")


def extend(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the rows of words it lacks."""
    return cache.unionByName(new.join(cache.select("word"), "word", "left_anti"))


def embed_once(words: DataFrame, path: str, encoders: dict) -> DataFrame:
    """``words`` with vectors from the cache at ``path``; only distinct words that it lacks are encoded and appended.

    ``encoders`` maps a vector column to an encoder, as for ``embed_text``.  A null word has no vectors.
    """
    from ..functions.encoders import embed_text
    from .history import existing

    spark = words.sparkSession
    cache = existing(spark, path)
    asked = words.select("word").filter("word is not null").distinct()
    new = asked if cache is None else missing(asked, cache)
    write_vectors(embed_text(cut(new), "word", encoders), path, append=True)
    stored = spark.read.parquet(path).select(F.col("word").alias("_word"), *encoders)
    return words.join(stored, F.col("word") == F.col("_word"), "left").drop("_word")


def write_archive(vectors: DataFrame, path: str, models: dict[str, str]) -> DataFrame:
    """Vectors under ``path/vectors`` and, beside them, their metadata, which is returned: a row per space with its
    model, its dimension, how many words have it, and when it was written."""
    spark = vectors.sparkSession
    write_vectors(vectors, f"{path}/vectors")
    stored = read_vectors(spark, f"{path}/vectors")
    counted = stored.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(s).alias(f"n_{s}") for s in models], *[F.max(F.size(s)).alias(f"d_{s}") for s in models]
    )
    each = F.array(*[
        F.struct(F.lit(s).alias("space"), F.lit(m).alias("model"), F.col(f"d_{s}").alias("dimension"), F.col(f"n_{s}").alias("words"))
        for s, m in models.items()
    ])
    meta = cut(counted.select("total", F.inline(each)).withColumn("written_at", F.current_timestamp()))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return spark.read.parquet(f"{path}/metadata")


def archive_summary(vectors: DataFrame) -> DataFrame:
    """Metadata of an archive: words per category and the dimensions of both spaces."""
    return vectors.groupBy("category").agg(
        F.count(F.lit(1)).alias("words"),
        F.max(F.size("visual")).alias("visual_dim"),
        F.max(F.when(F.col("semantic").isNotNull(), F.size("semantic"))).alias("semantic_dim"),
    )


def write_vectors(vectors: DataFrame, path: str, append: bool = False) -> None:
    vectors.write.mode("append" if append else "overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
