"""Diversity of the words of a category, in one space, in both, or blended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import dominant_space
from . import moments as M
from .pairs import pair_stats, top_pairs
from .tiles import TILE_ROWS


def diversity(
    df: DataFrame,
    gate: str = "joint",
    alpha: float = 0.5,
    threshold: float = 0.85,
    by: list[str] = ["category"],
    rows: int = TILE_ROWS,
) -> DataFrame:
    """Count, mean/min/max/std of the pair similarities, extreme pairs, redundant pairs per category."""
    s = pair_stats(df, by, [gate], alpha, threshold, rows)
    return s.select(
        *by,
        "count",
        "mean_similarity",
        "min_similarity",
        "max_similarity",
        "std_similarity",
        F.col("most_similar.a").alias("similar_a"),
        F.col("most_similar.b").alias("similar_b"),
        F.col("most_distant.a").alias("distant_a"),
        F.col("most_distant.b").alias("distant_b"),
        "redundant_pairs",
    )


def spread_or_zero(df: DataFrame, gate: str, by: list[str], threshold: float = 0.85, rows: int = TILE_ROWS) -> DataFrame:
    """Mean, min, max, range, std and redundant pairs; all 0 for a group of fewer than two words."""
    s = pair_stats(df, by, [gate], threshold=threshold, rows=rows)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.select(
        *by,
        "count",
        z("mean_similarity").alias("mean"),
        z("min_similarity").alias("min"),
        z("max_similarity").alias("max"),
        (z("max_similarity") - z("min_similarity")).alias("range"),
        z("std_similarity").alias("std"),
        "redundant_pairs",
    )


def cross_spread(left: DataFrame, right: DataFrame, gate: str = "visual", rows: int = TILE_ROWS) -> DataFrame:
    """Mean, min and max similarity over all pairs of two sets."""
    import pyarrow as pa

    from . import tiles as T

    cols = ["ordinal", "visual", "semantic"]

    def kernel(table: pa.Table) -> pa.Table:
        side = T.A.column(table, "_side")
        a = T.Block(table.filter(pa.array(side == 0)))
        b = T.Block(table.filter(pa.array(side == 1)))
        got = [(m[gate].sum(), m[gate].size, m[gate].min(), m[gate].max()) for _, m in T.strips(a, b, [gate], 0.5)] if len(a) and len(b) else []
        t = lambda f, i: [float(f(x[i] for x in got))] if got else [None]
        return pa.table(
            [pa.array(t(sum, 0), pa.float64()), pa.array(t(sum, 1), pa.float64()),
             pa.array(t(min, 2), pa.float64()), pa.array(t(max, 3), pa.float64())],
            names=["s", "n", "lo", "hi"],
        )

    tiled = T.cross_tiles(left.select(*cols), right.select(*cols), "ordinal", rows)
    parts = T.per_tile(tiled, [], kernel, "s double, n double, lo double, hi double")
    return parts.agg(
        (F.sum("s") / F.sum("n")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )


def space_weights(df: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Per category: spread in each space and the share of the variance that is visual (alpha)."""
    s = pair_stats(df, ["category"], ["visual", "semantic"], rows=rows)
    has = df.groupBy("category").agg(F.max(F.col("semantic").isNotNull()).alias("dual"))
    pick = lambda g, c: F.max(F.when(F.col("gate") == g, F.col(c)))
    wide = s.groupBy("category").agg(
        *[
            pick(g, c).alias(f"{g}_{n}")
            for g in ("visual", "semantic")
            for c, n in (
                ("mean_similarity", "mean"), ("std_similarity", "std"), ("var_similarity", "var"),
                ("min_similarity", "min"), ("max_similarity", "max"),
            )
        ]
    ).join(has, "category")
    total = F.col("visual_var") + F.col("semantic_var")
    raw = F.when(total > 0, F.col("visual_var") / total).otherwise(0.5)
    alpha = F.when(F.col("dual"), F.round(raw, 3)).otherwise(1.0)
    return wide.select(
        "category",
        "visual_mean", "visual_std", (F.col("visual_max") - F.col("visual_min")).alias("visual_range"), "visual_var",
        "semantic_mean", "semantic_std",
        (F.col("semantic_max") - F.col("semantic_min")).alias("semantic_range"), "semantic_var",
        alpha.alias("alpha"),
        dominant_space(F.when(F.col("dual"), raw).otherwise(1.0)).alias("winner"),
    )


def space_weight_summary(weights: DataFrame) -> DataFrame:
    label = dominant_space(F.col("alpha"))
    return weights.agg(
        F.avg("alpha").alias("mean_alpha"),
        F.min("alpha").alias("min_alpha"),
        F.max("alpha").alias("max_alpha"),
        F.count_if(label == "visual").alias("visual_dominant"),
        F.count_if(label == "semantic").alias("semantic_dominant"),
        F.count_if(label == "balanced").alias("balanced"),
    )


def space_correlation(df: DataFrame) -> DataFrame:
    """Pearson r between the spaces per category, and over all within-category pairs (category NULL)."""
    sums = M.pair_sums(df, ["category"])
    total = sums.rollup("category").agg(*[F.sum(c).alias(c) for c in ("pairs", "x", "y", "xx", "yy", "xy")])
    n = F.col("pairs").cast("double")
    c = F.col
    return total.select(
        "category",
        "pairs",
        F.when(n > 0, c("x") / n).alias("visual_mean"),
        F.when(n > 0, c("y") / n).alias("semantic_mean"),
        M.correlation(n, c("x"), c("y"), c("xx"), c("yy"), c("xy")).alias("pearson_r"),
    )


def spread_by_moments(df: DataFrame) -> DataFrame:
    """Standard deviation of the pair similarities per category in both spaces, without pairs."""
    s = M.pair_sums(df, ["category"])
    n = F.col("pairs").cast("double")
    return s.select(
        "category",
        M.mean_std(F.col("x"), F.col("xx"), n)[1].alias("visual_std"),
        M.mean_std(F.col("y"), F.col("yy"), n)[1].alias("semantic_std"),
    )


def redundancy_agreement(df: DataFrame, threshold: float = 0.85, rows: int = TILE_ROWS) -> DataFrame:
    """Jaccard overlap of the pairs each space calls redundant."""
    s = pair_stats(df, ["category"], ["visual"], threshold=threshold, rows=rows)
    return s.select(
        "category",
        F.col("over_both").alias("both"),
        F.col("over_any").alias("either"),
        (F.col("over_both") / F.greatest(F.col("over_any"), F.lit(1))).alias("jaccard"),
    )


def pair_disagreement(df: DataFrame, k: int, visual_closer: bool, rows: int = TILE_ROWS) -> DataFrame:
    """The k word pairs whose spaces differ most, in one direction, over the whole pool."""
    top = top_pairs(df, "gap", k, largest=visual_closer, rows=rows)
    return top.select("word_a", "word_b", "sim_visual", "sim_semantic", F.col("score").alias("gap"))


def models_as_rows(df: DataFrame, spaces: dict[str, str]) -> DataFrame:
    """Rows with a vector column per model as rows (model, category, ordinal, word, vector); ``spaces`` maps a model
    to its column, and any number of models may share one."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("vector")) for m, c in spaces.items()])
    return df.select("category", "ordinal", "word", F.explode(each).alias("m")).select("m.model", "category", "ordinal", "word", "m.vector")


def by_model(df: DataFrame, threshold: float = 0.85, rows: int = TILE_ROWS) -> DataFrame:
    """Per (model, category) spread of rows (model, category, ordinal, word, vector): any number of models.

    Words without a vector of a model do not count for it.
    """
    one = df.filter("vector is not null").select(
        "model", "category", "ordinal", "word", F.col("vector").alias("visual"), F.lit(None).cast("array<double>").alias("semantic")
    )
    s = pair_stats(one, ["model", "category"], ["visual"], threshold=threshold, rows=rows)
    z = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return s.select(
        "model",
        "category",
        z("mean_similarity").alias("mean"),
        z("min_similarity").alias("min"),
        z("max_similarity").alias("max"),
        z("std_similarity").alias("std"),
        "redundant_pairs",
    )


def model_pivot(stats: DataFrame, models: list[str]) -> DataFrame:
    """Category by model table of the mean similarity."""
    return stats.groupBy("category").pivot("model", models).agg(F.first("mean"))


def principal_axes(df: DataFrame, k: int = 2, column: str = "visual") -> DataFrame:
    """Projection on the first k principal axes, with the share of variance each explains.

    Signs are fixed so that the largest loading of every axis is positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select("*", array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    mean = v.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()  # one d-vector
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    axes = model.pc.toArray()
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    shift = (mean @ axes) * flip
    raw = vector_to_array("_p")
    out = model.transform(v)
    coords = {
        f"axis_{i + 1}": F.element_at(raw, i + 1) * F.lit(float(flip[i])) - F.lit(float(shift[i])) for i in range(k)
    }
    shares = {f"explained_{i + 1}": F.lit(float(model.explainedVariance[i])) for i in range(k)}
    return out.withColumns({**coords, **shares}).drop("_v", "_p")
