"""Pools against each other: overlap, consensus, unique words, category agreement, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import verdict
from ..sources.pools import word_category


def _pool_pairs(wc: DataFrame) -> DataFrame:
    """Every pair of pools with the number of words of each (pools are few: a dimension, not data)."""
    return pairs_of(wc.groupBy("pool").agg(F.count(F.lit(1)).alias("n")))


def pairs_of(sizes: DataFrame) -> DataFrame:
    """(pool_a, pool_b, n_a, n_b) of every pair of the rows (pool, n)."""
    names = sizes.agg(F.array_sort(F.collect_list(F.struct("pool", "n"))).alias("p"))
    one = names.select(F.posexplode("p").alias("i", "a"), "p")
    two = one.select("i", "a", F.posexplode("p").alias("j", "b")).filter("i < j")
    return two.select(F.col("a.pool").alias("pool_a"), F.col("b.pool").alias("pool_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def _shared(wc: DataFrame) -> DataFrame:
    """Words two pools share, with the category in each; a word has at most one row per pool here."""
    a = wc.select("word", F.col("pool").alias("pool_a"), F.col("category").alias("category_a"))
    b = wc.select("word", F.col("pool").alias("pool_b"), F.col("category").alias("category_b"))
    return a.join(b, "word").filter("pool_a < pool_b")


def pool_overlap(components: DataFrame) -> DataFrame:
    """Shared and exclusive words and the Jaccard index of every pair of pools."""
    wc = word_category(components)
    shared = _shared(wc).groupBy("pool_a", "pool_b").agg(F.count(F.lit(1)).alias("shared"))
    s = F.coalesce("shared", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - s
    return _pool_pairs(wc).join(shared, ["pool_a", "pool_b"], "left").select(
        "pool_a", "pool_b", s.cast("bigint").alias("shared"), (F.col("n_a") - s).alias("only_a"), (F.col("n_b") - s).alias("only_b"),
        F.when(union > 0, F.round(s / union, 4)).otherwise(0.0).alias("jaccard"),
    )


def category_agreement(components: DataFrame) -> DataFrame:
    """Of the shared words, how many sit in the same category of both pools."""
    same = F.col("category_a") == F.col("category_b")
    return _shared(word_category(components)).groupBy("pool_a", "pool_b").agg(
        F.count(F.lit(1)).alias("shared"),
        F.count_if(same).alias("same_category"),
        F.count_if(~same).alias("other_category"),
    )


def category_disagreements(components: DataFrame, k: int = 10) -> DataFrame:
    """The first k shared words, by name, that two pools file differently."""
    w = Window.partitionBy("pool_a", "pool_b").orderBy("word")
    differ = _shared(word_category(components)).filter("category_a <> category_b")
    return differ.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _by_word(components: DataFrame) -> tuple[DataFrame, int]:
    wc = word_category(components)
    n_pools = components.select("pool").distinct().count()
    return wc, n_pools


def consensus(components: DataFrame, first_pool: str) -> DataFrame:
    """Words of all pools, with the category of the first pool."""
    wc, n = _by_word(components)
    return (
        wc.groupBy("word")
        .agg(F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("pool") == first_pool, F.col("category"))).alias("category"))
        .filter(F.col("c") == n)
        .select("category", "word")
    )


def unique_words(components: DataFrame) -> DataFrame:
    """Words only one pool has."""
    wc = word_category(components)
    return (
        wc.groupBy("word")
        .agg(F.count(F.lit(1)).alias("c"), F.first("pool").alias("pool"), F.first("category").alias("category"))
        .filter("c = 1")
        .select("pool", "category", "word")
    )


def pool_sizes(components: DataFrame, pools: list[str]) -> DataFrame:
    """Items per category and pool with a row of totals (category ``TOTAL``)."""
    counts = components.groupBy("category", "pool").count()
    per = [F.coalesce(F.sum(F.when(F.col("pool") == p, F.col("count"))), F.lit(0)).alias(p) for p in pools]
    rolled = counts.rollup("category").agg(F.grouping("category").alias("g"), *per)
    return rolled.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("category")).alias("category"), *pools)


def compare_means(baseline: DataFrame, proposed: DataFrame) -> DataFrame:
    """(category, count, mean_similarity) of two pools side by side, with a verdict."""
    old = baseline.select("category", F.col("count").alias("old_count"), F.col("mean_similarity").alias("old_mean"))
    new = proposed.select("category", F.col("count").alias("new_count"), F.col("mean_similarity").alias("new_mean"))
    delta = F.col("new_mean") - F.col("old_mean")
    label = (
        F.when(F.col("old_count").isNull(), "new category")
        .when(F.col("new_count").isNull(), "removed")
        .otherwise(verdict(delta))
    )
    return old.join(new, "category", "full_outer").select(
        "category", "old_count", "new_count", "old_mean", "new_mean", delta.alias("delta"), label.alias("verdict")
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Improved and degraded categories; all others count as unchanged."""
    v = F.col("verdict")
    return compared.agg(
        F.count_if(v == "better").alias("improved"),
        F.count_if(v == "worse").alias("degraded"),
        F.count_if(~v.isin("better", "worse")).alias("unchanged"),
    )
