"""Words against category centroids: contamination, re-allocation, confidence, gaps between categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions.labels import QUADRANTS, quadrant
from ..session import cut
from . import tiles as T
from .moments import centroids
from .pairs import top_pairs

SPACES = ("visual", "semantic", "joint")


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _scores(v, s, has_s, cv, cs, has_cs, alpha):
    """Similarities of word rows to centroid rows in each space (NaN where a space is missing)."""
    sv = v @ cv.T
    if s is None or cs is None:
        ss = np.full_like(sv, np.nan)
    else:
        ss = s @ cs.T
        ss[~has_s] = np.nan
        ss[:, ~has_cs] = np.nan
    return {"visual": sv, "semantic": ss, "joint": np.where(np.isnan(ss), sv, alpha * sv + (1 - alpha) * ss)}


def closest_centroids(
    words: DataFrame,
    scope: list[str] = [],
    cents: DataFrame | None = None,
    alpha: float = 0.5,
    broadcast_bytes: int = T.BROADCAST_BYTES,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Per word and space: similarity to its own centroid, best similarity, and the category of the best.

    Ties go to the category that appears first in the pool.  A word whose category, or scope, has no
    centroid keeps its row, with NULL where there is nothing to compare.  ``scope`` (for example ``pool``) keeps
    separate sets of centroids apart.  Centroids measured to be small are shipped to the tasks;
    otherwise words meet them tile by tile, and the partial bests are merged map-side.
    """
    cents = centroids(words, [*scope, "category"]) if cents is None else cents
    cents = cents.select(*scope, "category", "first", "visual", "semantic").persist()
    m = cents.agg(F.count(F.lit(1)), F.max(F.size("visual")), F.max(F.coalesce(F.size("semantic"), F.lit(0)))).first()
    size = int(m[0]) * (int(m[1] or 0) + int(m[2] or 0)) * 8
    keep = [*scope, "category", "ordinal", "word"]
    cat_t = words.schema["category"].dataType.simpleString()
    body = ", ".join(f"own_{x} double, best_{x} double, says_{x} {cat_t}" for x in SPACES)

    if size <= broadcast_bytes:
        table = cents.toArrow().sort_by("first")
        groups: dict[tuple, np.ndarray] = {}
        for i, row in enumerate(table.select(scope).to_pylist() if scope else [{}] * table.num_rows):
            groups.setdefault(tuple(row.values()), []).append(i)
        packs = {}
        for key, idx in groups.items():
            sub = table.take(pa.array(idx))
            cv, _ = A.matrix(sub.column("visual"))
            cs, has = A.matrix(sub.column("semantic"))
            packs[key] = (sub.column("category").combine_chunks(), cv, cs, has)
        held = words.sparkSession.sparkContext.broadcast(packs)
        cat_type = table.schema.field("category").type

        def scan(batches):
            for b in batches:
                names = b.schema.names
                keys = list(zip(*[b.column(names.index(c)).to_pylist() for c in scope])) if scope else [()] * b.num_rows
                for key in dict.fromkeys(keys):
                    idx = pa.array([i for i, k in enumerate(keys) if k == key], pa.int64())
                    sub = b.take(idx) if scope else b
                    if key not in held.value:  # a scope without centroids: nothing to compare with
                        none = [pa.nulls(sub.num_rows, t) for _ in SPACES for t in (pa.float64(), pa.float64(), cat_type)]
                        heads = [f"{p}_{x}" for x in SPACES for p in ("own", "best", "says")]
                        yield pa.RecordBatch.from_arrays([*(sub.column(names.index(c)) for c in keep), *none], names=[*keep, *heads])
                        continue
                    cats, cv, cs, has_c = held.value[key]
                    v, _ = A.matrix(sub.column(names.index("visual")))
                    s, has = A.matrix(sub.column(names.index("semantic")))
                    place = {c: i for i, c in enumerate(cats.to_pylist())}
                    own_at = np.array([place.get(c, -1) for c in sub.column(names.index("category")).to_pylist()])
                    cols = [sub.column(names.index(c)) for c in keep]
                    for x in SPACES:
                        sim = _scores(v, s, has, cv, cs, has_c, alpha)[x]
                        gone = np.isnan(sim).all(axis=1)
                        at = np.where(np.isnan(sim), -np.inf, sim).argmax(axis=1)
                        r = np.arange(len(sim))
                        own = np.where(own_at >= 0, sim[r, own_at], np.nan)
                        cols += [
                            pa.array(own, mask=np.isnan(own)),
                            pa.array(sim[r, at], mask=gone),
                            cats.take(pa.array(at, pa.int64(), mask=gone)),
                        ]
                    heads = [f"{p}_{x}" for x in SPACES for p in ("own", "best", "says")]
                    yield pa.RecordBatch.from_arrays([c for c in cols], names=[*keep, *heads])

        need = words.select(*keep, "visual", "semantic")
        return need.mapInArrow(scan, f"{_ddl(need, keep)}, {body}")

    # Rows repeated in full share one result; rows that differ in their vectors only do not.
    print_of = F.xxhash64("visual", "semantic")
    all_rows = words.select(*keep, print_of.alias("_v"))
    merge_by = [*keep, "_v"]
    need = words.select(*keep, "visual", "semantic", print_of.alias("_v"), F.xxhash64(*keep).alias("_k"))
    other = cents.select(
        *scope, "category", F.col("first").alias("ordinal"),
        F.lit(None).cast(words.schema["word"].dataType).alias("word"),
        "visual", "semantic", F.lit(0).cast("bigint").alias("_v"), F.xxhash64(*scope, "category").alias("_k"),
    )
    tiled = T.cross_tiles(need, other.select(*need.columns), "_k", rows)
    part = ", ".join(f"own_{x} double, best_{x} double, at_{x} bigint, says_{x} {cat_t}" for x in SPACES)

    def kernel(t: pa.Table) -> pa.Table:
        side = A.column(t, "_side")
        w, c = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)).sort_by("ordinal")
        if not c.num_rows:
            w = w.slice(0, 0)
        if not w.num_rows:
            c = c.slice(0, 0)
        cols = [A.plain(w.column(k)) for k in merge_by]
        if not w.num_rows:
            empty = [pa.array([], f) for _ in SPACES for f in (pa.float64(), pa.float64(), pa.int64())]
            cats = A.plain(c.column("category"))
            out, j = list(cols), 0
            for _ in SPACES:
                out += [*empty[j : j + 3], cats]
                j += 3
            return pa.table(out, names=[*merge_by, *[f"{p}_{x}" for x in SPACES for p in ("own", "best", "at", "says")]])
        cats, ords = A.plain(c.column("category")), A.column(c, "ordinal").astype(np.int64)
        wk = list(zip(*[w.column(k).to_pylist() for k in [*scope, "category"]]))
        ck = list(zip(*[c.column(k).to_pylist() for k in [*scope, "category"]]))
        place = {k: i for i, k in enumerate(ck)}
        scope_codes: dict[tuple, int] = {}
        code = lambda k: scope_codes.setdefault(k[:-1], len(scope_codes))
        wcode, ccode = np.array([code(k) for k in wk]), np.array([code(k) for k in ck])
        own_at = np.array([place.get(k, -1) for k in wk])
        v, s = A.matrix(w.column("visual"))[0], A.matrix(w.column("semantic"))
        cv, cs = A.matrix(c.column("visual"))[0], A.matrix(c.column("semantic"))
        r = np.arange(len(wk))
        for x in SPACES:
            sim = _scores(v, s[0], s[1], cv, cs[0], cs[1], alpha)[x]
            sim = np.where(wcode[:, None] == ccode[None, :], sim, np.nan)
            gone = np.isnan(sim).all(axis=1)
            at = np.where(np.isnan(sim), -np.inf, sim).argmax(axis=1)
            own = np.where(own_at >= 0, sim[r, own_at], np.nan)
            cols += [
                pa.array(own, mask=np.isnan(own)), pa.array(sim[r, at], mask=gone),
                pa.array(ords[at], mask=gone), cats.take(pa.array(at, pa.int64(), mask=gone)),
            ]
        return pa.table(cols, names=[*merge_by, *[f"{p}_{x}" for x in SPACES for p in ("own", "best", "at", "says")]])

    parts = T.per_tile(tiled, [], kernel, f"{_ddl(need, merge_by)}, {part}")
    aggs = []
    for x in SPACES:
        order = F.when(F.col(f"best_{x}").isNotNull(), F.struct((-F.col(f"best_{x}")).alias("s"), F.col(f"at_{x}").alias("o")))
        aggs += [
            F.max(f"own_{x}").alias(f"own_{x}"), F.max(f"best_{x}").alias(f"best_{x}"),
            F.min_by(f"says_{x}", order).alias(f"says_{x}"),
        ]
    merged = parts.groupBy(*merge_by).agg(*aggs)
    renamed = merged.select(*[F.col(c).alias(f"_m_{c}") for c in merge_by], *[f"{p}_{x}" for x in SPACES for p in ("own", "best", "says")])
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in merge_by]
    return all_rows.join(renamed, same, "left").drop("_v", *[f"_m_{c}" for c in merge_by])


def contamination(words: DataFrame, alpha: float = 0.5, **kw) -> DataFrame:
    """Words closer, by blended similarity, to another category's centroid than to their own."""
    c = closest_centroids(words, alpha=alpha, **kw)
    return c.filter(F.col("says_joint") != F.col("category")).select(
        "word",
        F.col("category").alias("assigned"),
        F.col("says_joint").alias("closest"),
        F.col("own_joint").alias("sim_assigned"),
        F.col("best_joint").alias("sim_closest"),
        (F.col("best_joint") - F.col("own_joint")).alias("delta"),
        "ordinal",
    )


def worst_contamination(contaminated: DataFrame, k: int) -> DataFrame:
    return contaminated.orderBy(F.desc("delta"), "ordinal").limit(k)


def proposed_moves(words: DataFrame, min_delta: float = 0.01, **kw) -> DataFrame:
    """Moves on which both spaces agree: the same other category, both by more than ``min_delta``."""
    c = closest_centroids(words, **kw)
    dv = F.col("best_visual") - F.col("own_visual")
    ds = F.col("best_semantic") - F.col("own_semantic")
    semantic_agrees = F.col("says_semantic").isNull() | (
        (F.col("says_semantic") == F.col("says_visual")) & (ds > min_delta)
    )
    return c.filter((F.col("says_visual") != F.col("category")) & (dv > min_delta) & semantic_agrees).select(
        "word",
        "ordinal",
        F.col("category").alias("from_category"),
        F.col("says_visual").alias("to_category"),
        dv.alias("delta_visual"),
        F.coalesce(ds, F.lit(0.0)).alias("delta_semantic"),
    )


def largest_moves(moves: DataFrame, k: int = 5) -> DataFrame:
    return moves.orderBy(F.desc(F.col("delta_visual") + F.col("delta_semantic")), "ordinal").limit(k)


def reallocate(words: DataFrame, min_delta: float = 0.01, **kw) -> DataFrame:
    """The pool after the agreed moves, with ``moved``.  Moved words go to the end of their new category.

    Moves of different words never interact, so each moved word is replayed on its own.  Copies of a word
    inside a category are first combined (only the first copy can move, because the next finds the target
    taken), so a replay sees at most one row per category.
    """
    moves = proposed_moves(words, min_delta, **kw).groupBy("word", F.col("from_category").alias("category")).agg(
        F.min("ordinal").alias("ordinal"), F.min_by("to_category", "ordinal").alias("to_category")
    )
    moves = cut(moves)
    word_t = words.schema["word"].dataType.simpleString()
    cat_t = words.schema["category"].dataType.simpleString()
    held = words.select("word", "category", "ordinal").join(moves.select("word").distinct(), "word", "left_semi")
    touched = (
        held.groupBy("word", "category").agg(F.min("ordinal").alias("ordinal"))
        .join(moves.select("word", "category", "to_category"), ["word", "category"], "left")
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of one word: apply its moves in pool order; a move into a category that has the word is void."""
        pdf = pdf.sort_values("ordinal")
        now = list(pdf["category"])
        moved = [False] * len(now)
        for i, target in enumerate(pdf["to_category"]):
            if target is not None and not pd.isna(target) and target not in now:
                now[i], moved[i] = target, True
        return pd.DataFrame({"word": pdf["word"], "ordinal": pdf["ordinal"], "was": pdf["category"], "category": now, "moved": moved})

    result = touched.groupBy("word").applyInPandas(
        replay, f"word {word_t}, ordinal bigint, was {cat_t}, category {cat_t}, moved boolean"
    ).filter("moved")
    last = int(words.agg(F.max("ordinal")).first()[0] or 0)  # one scalar
    out = words.join(
        result.select("word", "ordinal", F.col("was").alias("category"), F.col("category").alias("_to")),
        ["word", "ordinal", "category"],
        "left",
    )
    moved = F.col("_to").isNotNull()
    return out.select(
        F.coalesce("_to", "category").alias("category"),
        F.when(moved, F.col("ordinal") + last + 1).otherwise(F.col("ordinal")).alias("ordinal"),
        *[c for c in words.columns if c not in ("category", "ordinal")],
        moved.alias("moved"),
    )


# ---- confidence -----------------------------------------------------------------------------------


def word_confidence(words: DataFrame, **kw) -> DataFrame:
    """Per (pool, word): own and best similarity in both spaces and the quadrant they put the word in."""
    c = closest_centroids(words, scope=["pool"], **kw)
    own_s = F.coalesce("own_semantic", F.lit(0.0))
    best_s = F.coalesce("best_semantic", F.lit(0.0))
    says_s = F.coalesce("says_semantic", "category")
    return c.select(
        "pool", "category", "ordinal", "word",
        F.col("own_visual").alias("visual_confidence"), own_s.alias("semantic_confidence"),
        F.col("says_visual").alias("visual_says"), says_s.alias("semantic_says"),
        F.col("best_visual").alias("visual_best"), best_s.alias("semantic_best"),
        quadrant(F.col("category"), F.col("own_visual"), F.col("best_visual"), F.col("says_visual"), own_s, best_s, says_s).alias("quadrant"),
    )


def confidence_by_category(conf: DataFrame) -> DataFrame:
    return conf.groupBy("pool", "category").agg(
        F.count(F.lit(1)).alias("count"),
        *[
            f(c).alias(f"{s}_{n}")
            for s, c in (("visual", "visual_confidence"), ("semantic", "semantic_confidence"))
            for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min))
        ],
    )


def quadrant_shares(conf: DataFrame) -> DataFrame:
    """Count and percentage of every quadrant per pool, zero-filled."""
    got = conf.groupBy("pool").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("quadrant") == q).alias(q) for q in QUADRANTS]
    )
    long = got.unpivot(["pool", "total"], list(QUADRANTS), "quadrant", "count")
    pct = F.when(F.col("total") > 0, F.round(F.col("count") / F.col("total") * 100, 1)).otherwise(0.0)
    return long.select("pool", "quadrant", "count", pct.alias("pct"))


def flagged(conf: DataFrame) -> DataFrame:
    """Words that at least one space would file elsewhere."""
    return conf.filter((F.col("visual_says") != F.col("category")) | (F.col("semantic_says") != F.col("category")))


def flag_counts(conf: DataFrame) -> DataFrame:
    v, s = F.col("visual_says") != F.col("category"), F.col("semantic_says") != F.col("category")
    return conf.groupBy("pool").agg(
        F.count_if(v & s).alias("both_disagree"),
        F.count_if(v & ~s).alias("visual_only"),
        F.count_if(~v & s).alias("semantic_only"),
    )


def weakest_flags(conf: DataFrame, k: int = 15) -> DataFrame:
    """Per pool the k words both spaces file elsewhere, least confident first."""
    both = (F.col("visual_says") != F.col("category")) & (F.col("semantic_says") != F.col("category"))
    w = Window.partitionBy("pool").orderBy(F.col("visual_confidence") + F.col("semantic_confidence"), "ordinal")
    return conf.filter(both).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def confidence_pivot(by_category: DataFrame, pools: list, value: str) -> DataFrame:
    return by_category.groupBy("category").pivot("pool", pools).agg(F.first(value))


def quadrant_pivot(shares: DataFrame, pools: list) -> DataFrame:
    return shares.groupBy("quadrant").pivot("pool", pools).agg(F.first("pct"))


# ---- categories against each other ----------------------------------------------------------------


def centroid_pairs(words: DataFrame, rows: int = T.TILE_ROWS) -> DataFrame:
    """Similarity of every ordered pair of category centroids: the report is the full matrix."""
    c = centroids(words, ["category"]).select(
        "category", F.col("first").alias("ordinal"), "visual", "semantic", F.xxhash64("category").alias("_k")
    )
    tiled = T.cross_tiles(c, c, "_k", rows)
    cat_t = words.schema["category"].dataType.simpleString()

    def kernel(t: pa.Table) -> pa.Table:
        side = A.column(t, "_side")
        a, b = T.Block(t.filter(pa.array(side == 0))), T.Block(t.filter(pa.array(side == 1)))
        dual = a.semantic is not None and b.semantic is not None
        n, m = len(a), len(b)
        ca, cb = A.plain(a.table.column("category")), A.plain(b.table.column("category"))
        i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        v = (a.visual @ b.visual.T).reshape(-1) if n and m else np.zeros(0)
        s = (a.semantic @ b.semantic.T).reshape(-1) if dual else np.zeros(len(v))
        return pa.table(
            [ca.take(pa.array(i)), cb.take(pa.array(j)), pa.array(v), pa.array(s, mask=np.full(len(v), not dual))],
            names=["a", "b", "sim_visual", "sim_semantic"],
        )

    return T.per_tile(tiled, [], kernel, f"a {cat_t}, b {cat_t}, sim_visual double, sim_semantic double")


def centroid_summary(words: DataFrame, space: str = "visual", rows: int = T.TILE_ROWS) -> DataFrame:
    """Mean, min, max and range over the pairs of categories, from similarities rounded to 4 digits."""
    sim = F.round(F.col(f"sim_{space}"), 4)
    return centroid_pairs(words, rows).filter(F.col("a") < F.col("b")).agg(
        F.avg(sim).alias("mean"), F.min(sim).alias("min"), F.max(sim).alias("max"),
        (F.max(sim) - F.min(sim)).alias("range"),
    )


def category_extremes(words: DataFrame, k: int, closest: bool, rows: int = T.TILE_ROWS) -> DataFrame:
    """The k closest or most distant pairs of categories by the average of both spaces."""
    top = top_pairs(_centroid_rows(words), "joint", k, largest=closest, alpha=0.5, rows=rows)
    return _named_pairs(top)


def space_disagreement(words: DataFrame, k: int = 15, rows: int = T.TILE_ROWS) -> DataFrame:
    """Pairs of categories on which the spaces differ most, and which space sees them closer."""
    rows_ = _centroid_rows(words)
    both = top_pairs(rows_, "gap", k, True, rows=rows).unionByName(top_pairs(rows_, "gap", k, False, rows=rows))
    named = _named_pairs(both.dropDuplicates(["ordinal_a", "ordinal_b"]))
    delta = F.abs(F.col("sim_visual") - F.col("sim_semantic"))
    return (
        named.withColumn("delta", delta)
        .withColumn("direction", F.when(F.col("sim_visual") > F.col("sim_semantic"), "visual closer").otherwise("semantic closer"))
        .orderBy(F.desc("delta"), "a", "b")
        .limit(k)
    )


def _centroid_rows(words: DataFrame) -> DataFrame:
    return centroids(words, ["category"]).select(F.col("first").alias("ordinal"), F.col("category").alias("word"), "visual", "semantic")


def _named_pairs(top: DataFrame) -> DataFrame:
    return top.select(
        F.least("word_a", "word_b").alias("a"), F.greatest("word_a", "word_b").alias("b"), "sim_visual", "sim_semantic"
    )


def isolation(words: DataFrame) -> DataFrame:
    """Mean similarity of each centroid to all others, from the sum of the centroids: no pairs."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    from ..functions.vectors import dot

    c = centroids(words, ["category"]).persist()
    k = c.count()

    def total(name: str):
        row = c.filter(F.col(name).isNotNull()).select(Summarizer.sum(array_to_vector(name)).alias("t")).first()
        return None if row is None or row.t is None or row.t.size == 0 else row.t.toArray()  # one d-vector

    ref = {n: total(n) for n in ("visual", "semantic")}

    def avg(name: str):
        if ref[name] is None or k < 2:
            return F.lit(None).cast("double")
        whole = F.lit(ref[name])
        return (dot(F.col(name), whole) - dot(F.col(name), F.col(name))) / (k - 1)

    return c.select("category", avg("visual").alias("visual_avg"), avg("semantic").alias("semantic_avg"))
