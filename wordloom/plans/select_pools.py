"""Gated selection: re-allocate, filter, pick, pair, report — all categories in the same jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection as S
from ..operators import tiles as T
from ..operators.centroids import reallocate
from ..operators.pairs import pair_stats
from ..session import cut
from ..sources.pools import NEGATABLE


@dataclass
class Selection:
    selected: DataFrame  # category, rank, ordinal, word, opposite
    summary: DataFrame  # one row per category
    pool: DataFrame  # the pool after re-allocation, with ``moved``


def select_pools(
    pool: DataFrame,
    k: int = 60,
    threshold: float = 0.85,
    move: bool = True,
    min_delta: float = 0.01,
    negatable=NEGATABLE,
    small: int = S.SMALL_GROUP,
    rows: int = T.TILE_ROWS,
) -> Selection:
    """``pool`` has category, ordinal, word, visual, semantic.

    Redundancy: alike in either space.  Selection: distinct in either space.  Opposites: semantic space.
    The elbow is reported only.
    """
    base = pool.select("category", "ordinal", "word", "visual", "semantic")
    base = reallocate(base, min_delta) if move else base.withColumn("moved", F.lit(False))
    base = cut(base)
    words = base.drop("moved")
    kept = cut(S.drop_redundant(words, threshold, small=small, rows=rows))
    picked = cut(S.diverse_words(kept, k, small=small, rows=rows))
    # pairing and statistics go by selection order
    ranked = picked.select("category", F.col("rank").cast("bigint").alias("ordinal"), "word", "visual", "semantic")
    pairs = S.opposite_pairs(ranked.filter(F.col("category").isin(*negatable)), small=small, rows=rows)
    selected = picked.select("category", "rank", "ordinal", "word").join(
        pairs.select("category", F.col("ordinal").cast("int").alias("rank"), "opposite"), ["category", "rank"], "left"
    )

    def stats(df: DataFrame, prefix: str) -> DataFrame:
        s = pair_stats(df, ["category"], ["either_distinct"], threshold=threshold, rows=rows)
        return s.select("category", F.col("count").alias(f"{prefix}_count"), F.col("mean_similarity").alias(f"{prefix}_mean"), F.col("most_similar").alias(f"{prefix}_similar"))

    n_kept = kept.groupBy("category").agg(F.count(F.lit(1)).alias("after_filter"))
    curve = _elbows(kept, k, small, rows)
    all_ = stats(words, "before").join(n_kept, "category", "left").join(curve, "category", "left").join(stats(ranked, "after"), "category", "left")
    before, after = F.col("before_mean"), F.col("after_mean")
    summary = all_.select(
        "category",
        F.col("before_count").alias("candidates"),
        F.coalesce("after_filter", F.lit(0)).alias("after_filter"),
        F.coalesce("after_count", F.lit(0)).alias("selected"),
        "elbow_k",
        (F.col("before_count") - F.coalesce("after_filter", F.lit(0))).alias("redundant_dropped"),
        F.round(before, 4).alias("before_mean_sim"),
        F.round(after, 4).alias("after_mean_sim"),
        F.round(before - after, 4).alias("improvement"),
        F.col("after_similar.a").alias("similar_a"),
        F.col("after_similar.b").alias("similar_b"),
        F.round("after_similar.sim", 4).alias("similarity"),
    )
    return Selection(selected, summary, base)


def _elbows(kept: DataFrame, k: int, small: int, rows: int) -> DataFrame:
    return S.elbow(kept, k + 20, small=small, rows=rows)
