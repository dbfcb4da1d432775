"""Aggregates over all pairs of a group: moments, extremes, counts over a threshold, top pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from . import tiles as T
from .cells import Cells, per_tile


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _first_extreme(sim: np.ndarray, mask: np.ndarray, oi: np.ndarray, oj: np.ndarray, sign: int):
    """Extreme entry, ties by the smaller (first, second) ordinals: (sim, row, column)."""
    if not mask.any():
        return None
    masked = np.where(mask, sign * sim, np.inf)
    low = masked.min()
    r, c = np.nonzero(masked == low)
    first, second = np.minimum(oi[r], oj[c]), np.maximum(oi[r], oj[c])
    k = np.lexsort((second, first))[0]
    return sign * low, int(r[k]), int(c[k])


def pair_stats(
    df: DataFrame,
    by: list[str],
    gates: list[str],
    alpha: float = 0.5,
    threshold: float = 0.85,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Per group and gate: count, pairs, sums, extremes with their pairs, pairs over the threshold.

    ``df`` holds ``by``, ``ordinal``, ``word``, ``visual`` and ``semantic``.  A tile pair returns one row
    per gate.  A group of one word has NULL statistics.  Two more columns count the pairs that both
    spaces, and at least one space, put over the threshold.
    """
    df = df.select(*by, "ordinal", "word", "visual", "semantic")
    word_t = df.schema["word"].dataType.simpleString()
    pair_t = f"struct<sim:double,i:bigint,j:bigint,a:{word_t},b:{word_t}>"
    schema = (
        f"{_ddl(df, by)}{', ' if by else ''}gate string, n bigint, pairs bigint, s double, ss double, "
        f"low {pair_t}, high {pair_t}, over bigint, over_both bigint, over_any bigint"
    )
    word_arrow = None

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        wa, wb = A.plain(a.table.column("word")), A.plain(b.table.column("word"))
        acc = {g: dict(pairs=0, s=0.0, ss=0.0, low=None, high=None, over=0) for g in gates}
        over_both = over_any = 0

        def better(old, new, sign):
            if new is None:
                return old
            if old is None:
                return new
            return min(old, new, key=lambda p: (sign * p[0], p[1], p[2]))

        def named(hit, start):
            if hit is None:
                return None
            sim, r, c = hit
            r += start
            if a.ordinal[r] <= b.ordinal[c]:
                return (sim, int(a.ordinal[r]), int(b.ordinal[c]), wa[r].as_py(), wb[c].as_py())
            return (sim, int(b.ordinal[c]), int(a.ordinal[r]), wb[c].as_py(), wa[r].as_py())

        for strip, sims in T.strips(a, b, sorted(set(gates) | {"either_similar", "either_distinct"}), alpha):
            mask = T.pair_mask(a, b, strip, same)
            if not mask.any():
                continue
            over_both += int(((sims["either_distinct"] > threshold) & mask).sum())
            over_any += int(((sims["either_similar"] > threshold) & mask).sum())
            for g in gates:
                sim, st = sims[g], acc[g]
                vals = sim[mask]
                st["pairs"] += len(vals)
                st["s"] += float(vals.sum())
                st["ss"] += float((vals * vals).sum())
                st["over"] += int((vals > threshold).sum())
                oi, oj = a.ordinal[strip], b.ordinal
                st["low"] = better(st["low"], named(_first_extreme(sim, mask, oi, oj, 1), strip.start), 1)
                st["high"] = better(st["high"], named(_first_extreme(sim, mask, oi, oj, -1), strip.start), -1)

        n = len(a) if same else 0
        fields = ("sim", "i", "j", "a", "b")
        cols = {c: [table.column(c)[0].as_py()] * len(gates) for c in by}
        cols["gate"] = list(gates)
        cols["n"] = [n] * len(gates)
        for k in ("pairs", "s", "ss"):
            cols[k] = [acc[g][k] for g in gates]
        for k in ("low", "high"):
            cols[k] = [None if acc[g][k] is None else dict(zip(fields, acc[g][k])) for g in gates]
        cols["over"] = [acc[g]["over"] for g in gates]
        cols["over_both"] = [over_both] * len(gates)
        cols["over_any"] = [over_any] * len(gates)
        word_type = table.schema.field("word").type
        pair_type = pa.struct(
            [("sim", pa.float64()), ("i", pa.int64()), ("j", pa.int64()), ("a", word_type), ("b", word_type)]
        )
        types = [table.schema.field(c).type for c in by] + [
            pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pair_type, pair_type,
            pa.int64(), pa.int64(), pa.int64(),
        ]
        return pa.table([pa.array(v, t) for v, t in zip(cols.values(), types)], names=list(cols))

    parts = T.pairwise(df, by, "ordinal", kernel, schema, rows)
    high_order = F.struct((-F.col("high.sim")).alias("s"), F.col("high.i").alias("i"), F.col("high.j").alias("j"))
    low_order = F.struct(F.col("low.sim").alias("s"), F.col("low.i").alias("i"), F.col("low.j").alias("j"))
    merged = parts.groupBy(*by, "gate").agg(
        F.sum("n").alias("n"),
        F.sum("pairs").alias("pairs"),
        F.sum("s").alias("s"),
        F.sum("ss").alias("ss"),
        F.min_by("low", F.when(F.col("low").isNotNull(), low_order)).alias("low"),
        F.min_by("high", F.when(F.col("high").isNotNull(), high_order)).alias("high"),
        F.sum("over").alias("over"),
        F.sum("over_both").alias("over_both"),
        F.sum("over_any").alias("over_any"),
    )
    mean = F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs"))
    var = F.when(F.col("pairs") > 0, F.greatest(F.col("ss") / F.col("pairs") - mean * mean, F.lit(0.0)))
    return merged.select(
        *by,
        "gate",
        F.col("n").alias("count"),
        "pairs",
        mean.alias("mean_similarity"),
        F.col("low.sim").alias("min_similarity"),
        F.col("high.sim").alias("max_similarity"),
        F.sqrt(var).alias("std_similarity"),
        var.alias("var_similarity"),
        F.col("high").alias("most_similar"),
        F.col("low").alias("most_distant"),
        F.col("over").alias("redundant_pairs"),
        "over_both",
        "over_any",
    )


def top_pairs(
    df: DataFrame,
    gate: str,
    k: int,
    largest: bool,
    alpha: float = 0.5,
    differ: str | None = None,
    extra: list[str] = [],
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """The k most extreme unordered pairs over the whole table: local top-k per tile pair, then top-k.

    A table of more than a tile is searched through cells: the most promising cells give a kth value first, and only
    cells whose bounds reach it are compared after that.
    """
    keep = ["ordinal", "word", *extra]
    need = df.select(*dict.fromkeys([*keep, *([differ] if differ else []), "visual", "semantic"]))
    sign = -1 if largest else 1
    left = [f"{c}_a" for c in keep]
    right = [f"{c}_b" for c in keep]
    types = [need.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(left + right, types + types))
    schema += ", sim_visual double, sim_semantic double, score double"

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        best = []
        for strip, sims in T.strips(a, b, [gate, "visual", "semantic"], alpha):
            masked = sign * sims[gate]
            if same or differ:
                masked = np.where(T.pair_mask(a, b, strip, same, differ), masked, np.inf)
            # ties with the k-th value stay, so that ordinals can decide
            kth = best[k - 1][0] if 0 < k <= len(best) else np.inf
            near = np.flatnonzero((masked <= kth) & (masked < np.inf))
            if len(near) > k > 0:
                few = masked.ravel()[near]
                near = near[few <= np.partition(few, k - 1)[k - 1]]
            if not len(near):
                continue
            r, c = np.divmod(near, masked.shape[1])
            score = sign * masked.ravel()[near]
            oi, oj = a.ordinal[r + strip.start], b.ordinal[c]
            order = np.lexsort((np.maximum(oi, oj), np.minimum(oi, oj), sign * score))[:k]
            best += [
                (sign * score[x], min(oi[x], oj[x]), max(oi[x], oj[x]), r[x] + strip.start, c[x],
                 sims["visual"][r[x], c[x]], sims["semantic"][r[x], c[x]])
                for x in order
            ]
            best = sorted(best)[:k]
        ra, cb = pa.array([x[3] for x in best], pa.int64()), pa.array([x[4] for x in best], pa.int64())
        ta, tb = a.table.select(keep).take(ra), b.table.select(keep).take(cb)
        swap = pa.array([bool(a.ordinal[x[3]] > b.ordinal[x[4]]) for x in best], pa.bool_())
        cols = {}
        for names, first, second in ((left, ta, tb), (right, tb, ta)):
            for n, c in zip(names, keep):
                x, y = A.plain(first.column(c)), A.plain(second.column(c))
                cols[n] = pc.if_else(swap, y, x) if len(best) else x
        cols["sim_visual"] = pa.array([x[5] for x in best], pa.float64())
        cols["sim_semantic"] = pa.array([x[6] for x in best], pa.float64())
        cols["score"] = pa.array([sign * x[0] for x in best], pa.float64())
        return pa.table(cols)

    order: list[Column] = [F.desc("score") if largest else F.asc("score"), F.asc("ordinal_a"), F.asc("ordinal_b")]
    if k <= 0 or T.peak_rows(need, []) <= rows:
        return T.per_tile(T.self_tiles(need, [], "ordinal", rows), [], kernel, schema).orderBy(*order).limit(k)
    index = Cells(need, "ordinal", rows)
    first = per_tile(index.tiles(need, [], gate, None, not largest, alpha), [], kernel, schema)
    values = [r.score for r in first.orderBy(*order).limit(k).select("score").collect()]
    bound = values[-1] if len(values) == k else sign * float("inf")
    return per_tile(index.tiles(need, [], gate, bound, not largest, alpha), [], kernel, schema).orderBy(*order).limit(k)
