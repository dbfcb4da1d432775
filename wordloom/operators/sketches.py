"""Overlap of many pools from theta sketches: one scan, a few kilobytes a pool, merged as new words come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .poolsets import pairs_of

LG_K = 12


def pool_sketches(components: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(pool, sketch) of each pool's distinct words, built map-side: a hot pool is one sketch a task."""
    return components.groupBy("pool").agg(F.theta_sketch_agg("word", lg_k).alias("sketch"))


def merged_sketches(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Sketches of parts of a pool as one."""
    return sketches.groupBy("pool").agg(F.theta_union_agg("sketch", lg_k).alias("sketch"))


def overlap_sketched(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Estimates of :func:`poolsets.pool_overlap` for every pair of pools; no word meets another.

    ``bound`` is three standard errors of ``shared`` at most: 3 / sqrt(2 ** lg_k) of the union, and 0 where all words
    of both pools fit their sketch, for then the numbers are exact.
    """
    n = F.theta_sketch_estimate("sketch").cast("bigint")
    pairs = pairs_of(sketches.select("pool", n.alias("n")))
    one = sketches.select(F.col("pool").alias("pool_a"), F.col("sketch").alias("a"))
    two = sketches.select(F.col("pool").alias("pool_b"), F.col("sketch").alias("b"))
    both = pairs.join(one, "pool_a").join(two, "pool_b")
    shared = F.theta_sketch_estimate(F.theta_intersection("a", "b")).cast("bigint")
    union = F.theta_sketch_estimate(F.theta_union("a", "b", lg_k)).cast("bigint")
    both = both.select("pool_a", "pool_b", "n_a", "n_b", shared.alias("shared"), union.alias("union"))
    return both.select(
        "pool_a", "pool_b", "shared",
        F.greatest(F.col("n_a") - F.col("shared"), F.lit(0)).alias("only_a"), F.greatest(F.col("n_b") - F.col("shared"), F.lit(0)).alias("only_b"),
        F.when(F.col("union") > 0, F.round(F.col("shared") / F.col("union"), 4)).otherwise(0.0).alias("jaccard"),
        F.when(F.greatest("n_a", "n_b") < 1 << lg_k, 0.0).otherwise(3 * F.col("union") / 2 ** (lg_k / 2)).alias("bound"),
    )
