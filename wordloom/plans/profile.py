"""Template profiles: sample, embed, measure, score, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoders import embed_text
from ..functions.labels import gated_scores
from ..operators.extremes import TILE_ROWS, pair_spread
from ..operators.generation import generate
from ..operators.moments import vector_sums
from ..operators.templates import combinations, parse_slots, structure_features

SPACES = {"visual": "visual", "semantic": "semantic"}


def sample_vectors(templates: DataFrame, components: DataFrame, n: int, seed: int = 42, spaces=SPACES, reuse: bool = True) -> DataFrame:
    """n prompts per template with their vectors: (template_id, ordinal, word, visual, semantic)."""
    prompts = generate(templates, components, n, seed, reuse=reuse, leave_missing=reuse)
    rows = prompts.select("template_id", F.col("prompt_no").alias("ordinal"), F.col("positive").alias("word"))
    return embed_text(rows, "word", spaces)


def vector_totals(vectors: DataFrame | None, by: str = "template_id", sums: DataFrame | None = None) -> DataFrame:
    """Per group: count and the sum of its vectors in both spaces, by position (a few rows per group); ``sums`` where known."""
    sums = vector_sums(vectors, [by]) if sums is None else sums
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("space"), F.col(s).alias("v")) for s in ("visual", "semantic")]))
    long = sums.select(by, "n", each.alias("s")).select(by, "n", "s.space", F.posexplode("s.v").alias("pos", "x"))
    return long.persist()  # read more than once by the callers


def cross_means(vectors: DataFrame | None, by: str = "template_id", sums: DataFrame | None = None) -> DataFrame:
    """Mean similarity of each group to all other groups: S_a . (S - S_a) / (n_a (n - n_a)), no pairs.  ``sums`` are the
    vector sums of the groups, where known."""
    t = vector_totals(vectors, by, sums)
    whole = t.groupBy("space", "pos").agg(F.sum("x").alias("all_x"), F.sum("n").alias("all_n"))
    other_n = F.first(F.col("all_n") - F.col("n"))
    both = t.join(whole, ["space", "pos"]).groupBy(by, "space").agg(
        F.sum(F.col("x") * (F.col("all_x") - F.col("x"))).alias("s"), F.first("n").alias("n"), other_n.alias("m")
    )
    mean = F.when(F.col("m") > 0, F.col("s") / (F.col("n") * F.col("m"))).otherwise(0.0)
    return both.groupBy(by).agg(
        *[F.max(F.when(F.col("space") == s, mean)).alias(f"{s}_cross_mean") for s in ("visual", "semantic")]
    )


def template_matrix(vectors: DataFrame, by: str = "template_id") -> DataFrame:
    """Mean similarity of every pair of groups (within a group: over its pairs), from vector sums.

    The join key is the vector position, and a group contributes one row per position.
    """
    t = vector_totals(vectors, by)
    a = t.select(F.col(by).alias("a"), "space", "pos", F.col("x").alias("xa"), F.col("n").alias("na"))
    b = t.select(F.col(by).alias("b"), "space", "pos", F.col("x").alias("xb"), F.col("n").alias("nb"))
    dots = a.join(b, ["space", "pos"]).groupBy("space", "a", "b").agg(
        F.sum(F.col("xa") * F.col("xb")).alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")
    )
    # unit vectors: the diagonal of the within-group product adds up to n
    within = F.when(F.col("na") > 1, (F.col("s") - F.col("na")) / (F.col("na") * (F.col("na") - 1))).otherwise(0.0)
    mean = F.when(F.col("a") == F.col("b"), within).otherwise(F.col("s") / (F.col("na") * F.col("nb")))
    return dots.groupBy("a", "b").agg(
        *[F.max(F.when(F.col("space") == s, mean)).alias(f"{s}_mean") for s in ("visual", "semantic")]
    )


def extreme_templates(matrix: DataFrame, space: str = "visual") -> DataFrame:
    """The most distinct and the most similar pair of templates."""
    v = F.col(f"{space}_mean")
    pairs = matrix.filter("a < b")
    low = pairs.agg(F.min_by(F.struct("a", "b", v.alias("similarity")), F.struct(v.alias("v"), "a", "b")).alias("p"))
    high = pairs.agg(F.min_by(F.struct("a", "b", v.alias("similarity")), F.struct((-v).alias("v"), "a", "b")).alias("p"))
    return low.select(F.lit("most_distinct").alias("kind"), "p.*").unionByName(high.select(F.lit("most_similar").alias("kind"), "p.*"))


def profile_templates(templates: DataFrame, components: DataFrame, n: int = 1000, seed: int = 42, spaces=SPACES,
                      vectors: DataFrame | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """One row per template: spread within, similarity to the others, structure, gated scores."""
    v = sample_vectors(templates, components, n, seed, spaces) if vectors is None else vectors
    spread = pair_spread(v, ["template_id"], ["visual", "semantic"], rows=rows)
    stats = spread.groups
    z = lambda g, e: F.max(F.when(F.col("gate") == g, F.coalesce(e, F.lit(0.0))))
    inner = stats.groupBy("template_id").agg(
        F.max("count").alias("n_samples"),
        *[z(g, F.col("mean_similarity")).alias(f"{g}_internal_mean") for g in ("visual", "semantic")],
        *[z(g, F.col("max_similarity") - F.col("min_similarity")).alias(f"{g}_internal_range") for g in ("visual", "semantic")],
    )
    slots = parse_slots(templates)
    combos = combinations(slots, components).select("template_id", F.col("permutations").alias("theoretical_combinations"))
    full = inner.join(cross_means(None, sums=spread.sums), "template_id").join(structure_features(slots), "template_id", "left").join(combos, "template_id", "left")
    c = F.col
    scores = gated_scores(c("visual_internal_mean"), c("visual_internal_range"), c("visual_cross_mean"),
                          c("semantic_internal_mean"), c("semantic_internal_range"), c("semantic_cross_mean"))
    return full.withColumns(scores)


def rank_profiles(profiles: DataFrame) -> DataFrame:
    """1-based rank by combined score (templates are few, so one window task is bounded)."""
    w = Window.orderBy(F.desc("combined_score"), "template_id")
    return profiles.withColumn("rank", F.row_number().over(w))


def against_baseline(profiles: DataFrame, baseline: DataFrame) -> DataFrame:
    """Score changes of each template; NULL where the baseline lacks it."""
    names = ("combined_score", "internal_score", "uniqueness_score")
    b = baseline.select("template_id", *[F.col(c).alias(f"_b_{c}") for c in names])
    return profiles.join(b, "template_id", "left").select(
        "template_id", *names, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in names]
    )


def prompt_diversity(vectors: DataFrame, alpha: float = 0.5, rows: int = TILE_ROWS) -> DataFrame:
    """Blended spread of the prompts per template, and over all prompts (template NULL)."""
    cols = ["template_id", "count", "mean_similarity", "min_similarity", "max_similarity"]
    spread = pair_spread(vectors, ["template_id"], ["joint"], alpha, whole=True, rows=rows)
    every = spread.whole.select(F.lit(None).cast("string").alias("template_id"), *cols[1:])
    return spread.groups.select(*cols).unionByName(every)
