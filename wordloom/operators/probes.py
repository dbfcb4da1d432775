"""Probing a vector space: voids, jitter, interpolation, vocabulary mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encoders import embed_text
from ..functions.hashing import md5_normal
from ..functions.text import vocabulary_token
from ..functions.vectors import interpolate, unit
from ..session import cut, spread, width
from .nearest import nearest

SCALES = (0.01, 0.05, 0.1, 0.2, 0.4)  # fixed values: radii of the jitter clouds


def _noise(key, dim: int):
    """``dim`` reproducible standard normals from a text key."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: md5_normal(F.concat_ws("/", key, i.cast("string"))))


def random_probes(spark: SparkSession, n: int, dim: int, seed: int = 42, tag: str = "probe") -> DataFrame:
    """(id, vector): n random directions; md5 noise, so every rerun and every engine gives the same ones."""
    ids = spark.range(n, numPartitions=max(1, min(spark.sparkContext.defaultParallelism, n // 256 + 1)))
    return ids.select("id", unit(_noise(F.concat_ws("/", F.lit(f"{seed}/{tag}"), F.col("id").cast("string")), dim)).alias("vector"))


def jitter(centers: DataFrame, scales=SCALES, n_per_scale: int = 8, seed: int = 42, tag: str = "jitter", parts: int | None = None) -> DataFrame:
    """A cloud around each centre for each scale: (id, scale, copy, vector), back on the unit sphere.

    ``centers`` has ``id`` and ``vector``.  With ``parts`` the clouds of few centres are dealt over so many tasks.
    """
    grid = centers.select("id", "vector", F.explode(F.lit(list(map(float, scales)))).alias("scale"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_per_scale - 1))).alias("copy"))
    if parts:
        grid = grid.repartition(parts, "id", "copy")
    key = F.concat_ws("/", F.lit(f"{seed}/{tag}"), F.col("id").cast("string"), F.col("scale").cast("string"), F.col("copy").cast("string"))
    noise = F.transform(
        F.sequence(F.lit(1), F.size("vector")), lambda i: md5_normal(F.concat_ws("/", key, i.cast("string")))
    )
    moved = F.zip_with(F.col("vector"), noise, lambda v, z: v.cast("double") + z * F.col("scale"))
    return grid.select("id", "scale", "copy", unit(moved).alias("vector"))


def interpolation(pairs: DataFrame, steps: int = 7) -> DataFrame:
    """Points from ``a`` to ``b`` at ``steps`` equal steps: (id, step, t, vector)."""
    if steps < 2:
        raise ValueError("steps must be at least 2")
    walk = pairs.select("id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    t = F.col("step") / F.lit(float(steps - 1))
    return walk.select("id", "step", t.alias("t"), interpolate(F.col("a"), F.col("b"), t).alias("vector"))


def _deepest(probes: DataFrame, base: DataFrame, n_voids: int, **kw) -> DataFrame:
    """The probes least similar to their nearest base vector."""
    near = nearest(probes.select("id", "vector"), base, **kw)
    top = near.select("id", (F.lit(1.0) - F.col("sim")).alias("distance"), "near", "near_word").orderBy(F.desc("distance"), "id").limit(n_voids)
    return top.join(probes.select("id", "vector"), "id")


def find_voids(base: DataFrame, dim: int, n_voids: int = 20, n_probes: int = 5000, seed: int = 42, **kw) -> DataFrame:
    """Random directions farthest from every base vector: (id, distance, near, near_word, vector).

    ``base`` has ``ordinal``, ``word``, ``vector``.
    """
    return _deepest(random_probes(base.sparkSession, n_probes, dim, seed), base, n_voids, **kw)


def find_voids_iterative(base: DataFrame, dim: int, n_voids: int = 20, n_probes: int = 2000, rounds: int = 3, seed: int = 42, **kw) -> DataFrame:
    """Voids refined by jitter around the best so far, tighter each round; keeps the best of all rounds."""
    base = base.persist()
    cols = ["id", "distance", "near", "near_word", "vector"]
    best = None
    for r in range(rounds):
        if best is None:
            probes = random_probes(base.sparkSession, n_probes, dim, seed, "round0")
        else:
            held = best.count()
            each = max(1, n_probes // held)
            # the voids held are n_voids rows at most; a round's ids follow those of the rounds before
            placed = best.select(F.row_number().over(Window.orderBy(F.desc("distance"), "id")).alias("id"), "vector")
            around = jitter(placed, (0.3 / (r + 1),), each, seed, f"round{r}", width(base.sparkSession))
            probes = around.select(((F.col("id") - 1) * each + F.col("copy") + r * max(n_probes, n_voids)).cast("bigint").alias("id"), "vector")
        found = _deepest(probes, base, n_voids, **kw).select(*cols)
        merged = found if best is None else best.select(*cols).unionByName(found)
        best = cut(merged.orderBy(F.desc("distance"), "id").limit(n_voids))
    base.unpersist()
    return best


def text_tokens(texts: DataFrame, pattern: str = r"\s+") -> DataFrame:
    """Distinct tokens of whole texts (``text``), combined before the shuffle."""
    return spread(texts.select("text")).select(F.explode(F.split("text", pattern)).alias("token")).distinct()


def mine_vocabulary(tokens: DataFrame, base: DataFrame, encoder, top_k: int = 100, **kw) -> DataFrame:
    """Vocabulary tokens farthest from their nearest pool word, farthest first.

    ``tokens`` has ``token``; equal clean tokens are embedded once.
    """
    # raw tokens are made distinct first: cleaning costs more than hashing, and texts repeat their words
    raw = tokens.select("token").distinct()
    clean = raw.select(vocabulary_token(F.col("token")).alias("id")).filter("id is not null").distinct()
    vectors = embed_text(clean.repartition(width(tokens.sparkSession)), "id", {"vector": encoder})
    near = nearest(vectors, base, **kw)
    return (
        near.select(F.col("id").alias("token"), (F.lit(1.0) - F.col("sim")).alias("distance"), "near_word")
        .orderBy(F.desc("distance"), "token")
        .limit(top_k)
    )
