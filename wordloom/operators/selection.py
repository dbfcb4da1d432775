"""Greedy operators: redundancy filter, diverse top-k, elbow, opposite pairs, distant pairs.

A group that fits one tile is solved in one task.  Larger groups are solved by rounds over tiles that
give the very same answer: state lives in rows, each round emits a few values per row or tile, and the
lineage is cut through the shared folder.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..session import cut, grouped, width
from . import tiles as T
from .cells import PART_BITS, Cells, per_tile
from .ordered import dense_index

SMALL_GROUP = 2048  # rows whose full similarity matrix (32 MB) one task holds with ease
WHOLE_BYTES = 64 << 20  # vectors of a group that one task walks without such a matrix
STRETCH, LEADERS = 256, 2048  # rows that the redundancy scan compares at once, and kept rows they meet at once
FRONTS = 8  # rounds of the redundancy filter, while a round's rows stay under a tile's bytes
LISTED, LISTED_EDGES = 64, 1 << 20  # least similar partners kept of a class, and of all classes of a group (24 MB)


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _by_size(df: DataFrame, by: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``limit`` rows, and the other rows (None when there are none)."""
    if T.peak_rows(df, by) <= limit:
        return df, None
    sizes = df.groupBy(*by).count()
    return (
        df.join(sizes.filter(F.col("count") <= limit).drop("count"), by, "left_semi"),
        df.join(sizes.filter(F.col("count") > limit).drop("count"), by, "left_semi"),
    )


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new ids, so two frames of one origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _full(block: T.Block, gate: str, alpha: float) -> np.ndarray:
    """The similarity matrix of one small group."""
    out = [m[gate] for _, m in T.strips(block, block, [gate], alpha)]
    return np.concatenate(out) if out else np.zeros((0, 0))


def _columns(block: T.Block, names: list[str]) -> list:
    return [A.plain(block.table.column(c)) for c in names]


# ---- redundancy -----------------------------------------------------------------------------------


def drop_redundant(
    df: DataFrame,
    threshold: float = 0.85,
    gate: str = "either_similar",
    by: list[str] = ["category"],
    small: int = SMALL_GROUP,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Scan each group in order; a kept word drops every later word above the threshold.

    Returns the kept rows with all columns.
    """
    return _redundancy(df, threshold, gate, by, small, rows).filter("kept").drop("kept")


def mark_redundant(df, threshold=0.85, gate="either_similar", by=["category"], small=SMALL_GROUP, rows=T.TILE_ROWS) -> DataFrame:
    """All rows with ``kept``."""
    return _redundancy(df, threshold, gate, by, small, rows)


def _redundancy(df, threshold, gate, by, small, rows) -> DataFrame:
    little, big = _by_size(df, by, _whole_rows(df, small))
    names = df.columns

    def scan(table: pa.Table) -> pa.Table:
        block = T.Block(table)
        return pa.table([*_columns(block, names), pa.array(_leaders(block, gate, threshold))], names=[*names, "kept"])

    out = grouped(little, by).applyInArrow(scan, f"{_ddl(df, names)}, kept boolean")
    if big is None:
        return out
    kept = _redundancy_rounds(big, threshold, gate, by, rows).withColumn("_kept", F.lit(True))
    marked = big.join(kept, [*by, "ordinal"], "left").withColumn("kept", F.col("_kept").isNotNull()).drop("_kept")
    return out.unionByName(marked.select(*out.columns))


def _some(block: T.Block, at: np.ndarray) -> T.Block:
    """The vectors of these rows of a block, without its table."""
    part = copy.copy(block)
    part.table, part.ordinal, part.visual, part.has_semantic = None, block.ordinal[at], block.visual[at], block.has_semantic[at]
    part.semantic = None if block.semantic is None else block.semantic[at]
    return part


def _near(a: T.Block, b: T.Block, gate: str, threshold: float) -> np.ndarray:
    """Which rows of ``a`` are above the threshold to any row of ``b``."""
    hit = np.zeros(len(a), bool)
    for at in range(0, len(b), LEADERS):
        left = np.flatnonzero(~hit)
        if not len(left):
            break
        for strip, sims in T.strips(_some(a, left), _some(b, np.arange(at, min(at + LEADERS, len(b)))), [gate], 0.5):
            hit[left[strip]] |= (sims[gate] > threshold).any(axis=1)
    return hit


def _leaders(block: T.Block, gate: str, threshold: float) -> np.ndarray:
    """Which rows of a block, in its order, no earlier kept row is above the threshold to.

    A stretch of rows meets the rows kept before it and then itself, so no matrix of all rows is held.
    """
    kept = np.zeros(len(block), bool)
    for at in range(0, len(block), STRETCH):
        rows = np.arange(at, min(at + STRETCH, len(block)))
        chosen = np.flatnonzero(kept[:at])
        for c in range(0, len(chosen), LEADERS):
            if not len(rows):
                break
            rows = rows[~_near(_some(block, rows), _some(block, chosen[c : c + LEADERS]), gate, threshold)]
        if not len(rows):
            continue
        own = _some(block, rows)
        sim, dropped = _full(own, gate, 0.5), np.zeros(len(own), bool)
        for i in range(len(own)):
            if not dropped[i]:
                dropped[i + 1 :] |= sim[i, i + 1 :] > threshold
        kept[rows[~dropped]] = True
    return kept


def _redundancy_rounds(df: DataFrame, threshold: float, gate: str, by: list[str], rows: int) -> DataFrame:
    """(by, ordinal) of the kept rows.  A round takes each group's next rows, ``FRONTS`` times fewer than the largest
    group has at first and no more than a tile's bytes of vectors, scans them in one task, and drops what later rows
    are above the threshold to one of those it keeps.

    A row meets each kept row before it at most once, in parts of a group that run beside each other.  Copies, and all
    of a dense cluster, go in the round that keeps their first row.
    """
    keys = [*by, "ordinal"]
    front = max(rows, min(math.ceil(T.peak_rows(df, by) / FRONTS), _whole_rows(df, SMALL_GROUP) // 2))
    step = max(1, front // 8)
    numbered = dense_index(df.select(*keys, "visual", "semantic"), by, "ordinal", "_at")
    left = cut(numbered.select(*keys, "visual", "semantic", F.floor((F.col("_at") - 1) / step).alias("_run")))
    head = _ddl(df, [*keys, "visual", "semantic"])

    def scan(table: pa.Table) -> pa.Table:
        block = T.Block(table)
        return block.table.select([*keys, "visual", "semantic"]).filter(pa.array(_leaders(block, gate, threshold)))

    def drop(table: pa.Table) -> pa.Table:
        block = T.Block(table)
        lead = np.asarray(A.column(block.table, "_lead")).astype(bool)
        rest, leaders = np.flatnonzero(~lead), np.flatnonzero(lead)
        free = rest[~_near(_some(block, rest), _some(block, leaders), gate, threshold)]
        return block.table.select([*keys, "visual", "semantic", "_run"]).take(pa.array(free))

    kept = []
    while True:
        runs = left.groupBy(*by, "_run").count()
        upto = Window.partitionBy(*by).orderBy("_run")
        runs = runs.withColumn("_sum", F.sum("count").over(upto)).withColumn("_first", F.first("_run").over(upto))
        runs = cut(runs.select(*by, "_run", "count", ((F.col("_sum") <= front) | (F.col("_run") == F.col("_first"))).alias("_now")))
        now = runs.filter("_now").select(*by, "_run")
        leaders = cut(grouped(left.join(F.broadcast(now), [*by, "_run"]), by).applyInArrow(scan, head))
        kept.append(leaders.select(*keys))
        parts = runs.filter("not _now").groupBy(*by).agg(F.ceil(F.sum("count") / front).cast("int").alias("_parts"))
        if parts.isEmpty():
            break
        later = left.join(F.broadcast(now), [*by, "_run"], "left_anti").join(F.broadcast(parts), by)
        later = later.withColumn("_part", F.pmod(F.xxhash64("ordinal"), F.col("_parts"))).withColumn("_lead", F.lit(False))
        each = leaders.join(F.broadcast(parts), by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        each = each.withColumn("_part", F.col("_part").cast("long")).withColumn("_lead", F.lit(True)).withColumn("_run", F.lit(None).cast("bigint"))
        cols = [*keys, "visual", "semantic", "_run", "_part", "_lead"]
        both = later.select(*cols).unionByName(each.select(*cols))
        left = cut(grouped(both, [*by, "_part"]).applyInArrow(drop, f"{head}, _run bigint"))
        if left.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


# ---- diverse top-k --------------------------------------------------------------------------------


def _pick(col, n: int, k: int, seeds: list[int], linkage: str) -> tuple[list[int], list[float]]:
    """Greedy picks among n words: the free word with the least linkage value, first index on ties.

    ``col`` gives the similarities of all words to one, so k * n of them are made and n are held.
    """
    fold = np.minimum if linkage == "min" else np.maximum
    picked, gain = list(seeds), [float("nan")] * len(seeds)
    cur = col(seeds[0]).copy()
    for s in seeds[1:]:
        cur = fold(cur, col(s))
    free = np.ones(n, bool)
    free[seeds] = False
    while len(picked) < k and free.any():
        at = int(np.where(free, cur, np.inf).argmin())
        picked.append(at)
        gain.append(float(cur[at]))
        free[at] = False
        if len(picked) < k:
            cur = fold(cur, col(at))
    return picked, gain


def _whole_rows(df: DataFrame, small: int) -> int:
    """Rows of a group that one task walks: ``small``, or by default as many as ``WHOLE_BYTES`` of vectors are."""
    if small < SMALL_GROUP:
        return small
    sizes = df.agg(F.max(F.size("visual")), F.max(F.size("semantic"))).first()
    return max(small, WHOLE_BYTES // (8 * max(sum(max(int(x or 0), 0) for x in sizes), 1)))


def diverse_words(
    df: DataFrame,
    k: int,
    gate: str = "either_distinct",
    linkage: str = "min",
    by: list[str] = ["category"],
    alpha: float = 0.5,
    seeds: DataFrame | None = None,
    seed_farthest_pair: bool = False,
    small: int = SMALL_GROUP,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Farthest-point selection: start at the first word, then add the word least similar to the chosen set.

    ``linkage='min'`` scores a word by its least similarity to the set (the default), ``'max'`` by its
    greatest.  Seeds may be given as rows (``by``, ``ordinal``), all of which stay, more than k too, or be the
    least similar pair.  A group of
    at most k words comes back whole, in order.  Adds ``rank`` (from 1) and ``similarity`` (the value at
    which the word was picked, NULL for seeds and whole groups).
    """
    names = df.columns
    if k <= 0:
        return df.withColumns({"rank": F.lit(0), "similarity": F.lit(0.0)}).filter(F.lit(False))
    if seeds is not None:
        flags = seeds.select(*by, "ordinal").distinct().withColumn("_seed", F.lit(True))
        df = df.join(flags, [*by, "ordinal"], "left").withColumn("_seed", F.coalesce("_seed", F.lit(False)))
    else:
        df = df.withColumn("_seed", F.lit(False))
    matrix, small = small, _whole_rows(df, small)
    little, big = _by_size(df, by, small)
    if seed_farthest_pair and small > matrix:  # of groups without a full matrix the pair is found by tiles
        wide = _by_size(little, by, matrix)[1]
        if wide is not None:
            from .pairs import pair_stats

            low = pair_stats(wide, by, [gate], alpha, rows=rows).select(*by, F.explode(F.array("most_distant.i", "most_distant.j")).alias("ordinal"))
            little = little.drop("_seed").join(cut(low).withColumn("_seed", F.lit(True)), [*by, "ordinal"], "left").withColumn("_seed", F.coalesce("_seed", F.lit(False)))
            little = little.select(*df.columns)

    def solve(table: pa.Table) -> pa.Table:
        block = T.Block(table)
        n = len(block)
        if n <= k and not seed_farthest_pair:
            picked, gain = list(range(n)), [float("nan")] * n
        else:
            start = np.nonzero(A.column(block.table, "_seed"))[0].tolist()
            if n <= matrix:
                sim = _full(block, gate, alpha)
                col = lambda i: sim[:, i]
            else:
                col = lambda i: np.concatenate([m[gate][:, 0] for _, m in T.strips(block, T.Block(block.table.slice(i, 1)), [gate], alpha)])
            if seed_farthest_pair and 1 < n <= matrix:
                off = sim + np.where(np.eye(n, dtype=bool), np.inf, 0.0)
                start = [int(x) for x in np.unravel_index(off.argmin(), off.shape)]
            picked, gain = _pick(col, n, min(k, n), start or [0], linkage)
        t = block.table.select(names).take(pa.array(picked, pa.int64()))
        t = t.append_column("rank", pa.array(np.arange(1, len(picked) + 1, dtype=np.int32)))
        g = np.asarray(gain, float)
        return t.append_column("similarity", pa.array(g, mask=np.isnan(g)))

    schema = f"{_ddl(df, names)}, rank int, similarity double"
    out = grouped(little, by).applyInArrow(solve, schema)
    if big is None:
        return out
    if not seed_farthest_pair:  # groups of at most k words need no rounds
        sizes = big.groupBy(*by).count()
        whole = big.join(sizes.filter(F.col("count") <= k).drop("count"), by, "left_semi")
        big = big.join(sizes.filter(F.col("count") > k).drop("count"), by, "left_semi")
        numbered = dense_index(whole, by, "ordinal", "rank").withColumn("rank", F.col("rank").cast("int"))
        out = out.unionByName(numbered.select(*names, "rank", F.lit(None).cast("double").alias("similarity")))
        if big.isEmpty():
            return out
    ranks = _diverse_rounds(big, k, gate, linkage, by, alpha, seed_farthest_pair, rows)
    return out.unionByName(big.select(*names).join(ranks, [*by, "ordinal"]).select(*names, "rank", "similarity"))


def _diverse_rounds(df, k, gate, linkage, by, alpha, farthest, rows) -> DataFrame:
    """(by, ordinal, rank, similarity) for large groups, all groups advancing together.

    Lazy greedy: a tile keeps the current score of each of its rows and how many picks they are held against.  The
    bounds of its cell say how far the picks it has not seen can move its best score, and only tiles that can hold the
    next pick are opened and held against those picks.  A row meets a pick once at most, so k picks of n rows are at
    most k * n products.  :func:`tile_state` is one step.
    """
    from .pairs import pair_stats

    keys = [*by, "ordinal"]
    work = cut(df.select(*keys, "visual", "semantic", "_seed"))
    index = Cells(work, "ordinal", rows)
    placed = index.assign(work)
    sizes = cut(placed.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_parts")))
    tile = F.shiftleft(F.col("_cell").cast("bigint"), PART_BITS) + F.pmod(F.xxhash64("ordinal"), F.col("_parts"))
    placed = placed.join(sizes, [*by, "_cell"]).withColumn("_tile", tile)
    head = _ddl(work, by)
    packs = cut(grouped(placed.select(*keys, "visual", "semantic", "_cell", "_tile"), [*by, "_tile"]).applyInArrow(_packed(by), f"{head}, _tile bigint, _cell int, ords binary, vis binary, sem binary, has binary"))
    if farthest:
        low = pair_stats(df, by, [gate], alpha, rows=rows).select(*by, F.array("most_distant.i", "most_distant.j").alias("o"))
        start = low.select(*by, F.posexplode("o").alias("p", "ordinal")).select(*by, "ordinal", (F.col("p") + 1).alias("rank"))
        chosen = work.join(start, keys)
    else:
        firsts = work.groupBy(*by).agg(F.max("_seed").alias("_any"), F.min("ordinal").alias("_first"))
        start = work.join(firsts, by).filter(F.when(F.col("_any"), F.col("_seed")).otherwise(F.col("ordinal") == F.col("_first")))
        from pyspark.sql import Window

        chosen = start.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("ordinal")))
    pick_cols = [*keys, "visual", "semantic", "rank", "similarity"]
    chosen = cut(chosen.withColumn("similarity", F.lit(None).cast("double")).select(*pick_cols))
    vec = "array<double>"
    none = {"cur": "binary", "best": "double", "ordinal": "bigint", "visual": vec, "semantic": vec, "least": "double", "most": "double"}
    state = packs.select(*by, "_tile", "_cell", *[F.lit(None).cast(x).alias(c) for c, x in none.items()], F.lit(0).alias("seen"))
    while True:  # at most k rounds: each gives every group that is still short of k its next word
        state = cut(tile_state(index, state, packs, chosen, k, gate, linkage, by, alpha))
        had = chosen.groupBy(*by).agg(F.max("rank").alias("r")).filter(F.col("r") < k)
        won = state.filter("exact").groupBy(*by).agg(F.min_by(F.struct("ordinal", "visual", "semantic", "best"), F.struct("best", "ordinal")).alias("w"))
        new = cut(won.join(had, by).select(*by, "w.ordinal", "w.visual", "w.semantic", (F.col("r") + 1).alias("rank"), F.col("w.best").alias("similarity")).select(*pick_cols))
        if new.isEmpty():
            break
        chosen = chosen.unionByName(new)
        state = state.drop("exact", "opened")
    return chosen.select(*keys, "rank", "similarity")


def _packed(by: list[str]):
    """One row for a tile, its rows in the order of their ordinals."""

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("ordinal").combine_chunks()
        v, _ = A.matrix(t.column("visual"))
        s, has = A.matrix(t.column("semantic"))
        blobs = [A.column(t, "ordinal").astype(np.int64), v, np.zeros(0) if s is None else s, has]
        return pa.table(
            [*[t.column(c).slice(0, 1) for c in by], t.column("_tile").slice(0, 1), t.column("_cell").slice(0, 1), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs]],
            names=[*by, "_tile", "_cell", "ords", "vis", "sem", "has"],
        )

    return pack


def tile_state(index: Cells, state: DataFrame, packs: DataFrame, chosen: DataFrame, k: int, gate: str, linkage: str, by: list[str], alpha: float) -> DataFrame:
    """The tiles' state after the last pick of each group of fewer than ``k``: ``exact`` tells that ``best`` holds for
    all picks, ``opened`` how many products this step took.

    ``best`` of a tile that has not seen all picks is bounded by the ``least`` and ``most`` similarity that its cell can
    have with those; null, where its own best row was picked, it says nothing.
    """
    held = state.sparkSession.sparkContext.broadcast(index.balls)
    fold = F.least if linkage == "min" else F.greatest

    def reach(batches):
        for b in batches:
            if b.num_rows:
                vectors = {s: A.matrix(b.column(b.schema.get_field_index(s))) for s in ("visual", "semantic")}
                low, high = held.value.bounds(vectors, gate, alpha)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], A.lists(low), A.lists(high)], [*b.schema.names[:-2], "lows", "highs"])

    # one row a group: its picks, k at most, the last one, and how similar the rows of each cell can be to that
    one_pick = F.struct("rank", F.col("ordinal").alias("o"), F.col("visual").alias("v"), F.col("semantic").alias("s"))
    last = chosen.groupBy(*by).agg(F.collect_list(one_pick).alias("picks"), F.max("rank").alias("_r"), F.max_by(F.struct("ordinal", "visual", "semantic"), "rank").alias("p"))
    last = last.filter(F.col("_r") < k).select(*by, "picks", F.col("p.ordinal").alias("gone"), F.col("p.visual").alias("visual"), F.col("p.semantic").alias("semantic"))
    groups = cut(last.mapInArrow(reach, f"{_ddl(last, [*by, 'picks', 'gone'])}, lows array<double>, highs array<double>"))
    rows = state.join(_renewed(groups.drop("picks")), by)
    low, high = F.get("lows", F.col("_cell")), F.get("highs", F.col("_cell"))
    rows = rows.withColumns({
        "best": F.when(F.col("gone") == F.col("ordinal"), F.lit(None).cast("double")).otherwise(F.col("best")),
        "least": F.coalesce(fold("least", low), low), "most": F.coalesce(fold("most", high), high),
    })
    # a free row of the tile scores ``best`` now; unseen picks fold between ``least`` and ``most`` into it
    rows = rows.withColumns({"floor": fold("best", "least"), "ceiling": fold("best", "most")})
    limit = rows.filter("best is not null").groupBy(*by).agg(F.min("ceiling").alias("limit"))
    rows = rows.join(limit, by, "left").withColumn("open", F.col("best").isNull() | F.col("limit").isNull() | (F.col("floor") <= F.col("limit")))
    keep = [*by, "_tile", "_cell", "cur", "best", "ordinal", "visual", "semantic", "least", "most", "seen"]
    rows = rows.select(*keep, "open")
    todo = rows.filter("open").select(*by, "_tile", "_cell", "cur", "seen").join(packs.drop("_cell"), [*by, "_tile"]).join(groups.select(*by, "picks"), by)
    todo = todo.repartition(width(state.sparkSession), *by, "_tile")
    minimum = linkage == "min"

    def step(batches):
        for b in batches:
            for r in range(b.num_rows):
                yield one(b.slice(r, 1))

    def one(b):
        get = lambda c: b.column(b.schema.get_field_index(c))[0]
        raw = lambda c, kind: np.frombuffer(get(c).as_buffer(), kind)
        picks = sorted(get("picks").as_py(), key=lambda p: p["rank"])
        ords, has = raw("ords", np.int64), raw("has", bool)
        m = len(ords)
        v, s = raw("vis", np.float64).reshape(m, -1), raw("sem", np.float64)
        s = s.reshape(m, -1) if len(s) else None
        seen = get("seen").as_py()
        cur = raw("cur", np.float64).copy() if get("cur").is_valid else None
        for p in picks[seen:]:
            x = v @ np.array(p["v"])
            y = np.where(has, s @ np.array(p["s"]), x) if s is not None and p["s"] is not None else x
            sim = {"visual": x, "semantic": y, "joint": alpha * x + (1.0 - alpha) * y, "either_similar": np.maximum(x, y), "either_distinct": np.minimum(x, y), "gap": x - y}[gate]
            cur = sim if cur is None else (np.minimum if minimum else np.maximum)(cur, sim)
        free = ~np.isin(ords, [p["o"] for p in picks])
        at = int(np.where(free, cur, np.inf).argmin()) if free.any() else None
        best = [None, None, None, None] if at is None else [float(cur[at]), int(ords[at]), v[at].tolist(), s[at].tolist() if has[at] else None]
        types = [pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        cols = [b.column(b.schema.get_field_index(c)) for c in (*by, "_tile", "_cell")]
        cols += [pa.array([cur.tobytes()], pa.binary()), *[pa.array([x], t) for x, t in zip(best, types, strict=True)]]
        cols += [pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([len(picks)], pa.int32()), pa.array([True]), pa.array([m * (len(picks) - seen)])]
        return pa.RecordBatch.from_arrays(cols, [*keep, "exact", "opened"])

    schema = f"{_ddl(state, by)}, _tile bigint, _cell int, cur binary, best double, ordinal bigint, visual array<double>, semantic array<double>, least double, most double, seen int, exact boolean, opened bigint"
    opened = todo.mapInArrow(step, schema).filter("best is not null")  # a tile without a free row has no part any more
    return rows.filter("not open").select(*keep, F.lit(False).alias("exact"), F.lit(0).cast("bigint").alias("opened")).unionByName(opened)


def elbow(
    df: DataFrame,
    max_k: int | None = None,
    gate: str = "either_distinct",
    by: list[str] = ["category"],
    small: int = SMALL_GROUP,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Per group the selection size after which the distance gained by the next word falls most.

    Groups of fewer than 4 words give their size; fewer than 3 gained distances give their number + 2.
    """
    from pyspark.sql import Window

    limit = max_k if max_k is not None else T.peak_rows(df, by)
    path = diverse_words(df, limit, gate, "min", by, seed_farthest_pair=True, small=small, rows=rows)
    gains = path.filter(F.col("similarity").isNotNull()).select(*by, "rank", (F.lit(1.0) - F.col("similarity")).alias("d"))
    w = Window.partitionBy(*by).orderBy("rank")  # at most max_k rows per group
    drops = gains.withColumn("fall", F.col("d") - F.lead("d").over(w))
    # ranks of gained words start at 3, so the first fall has index 0 = rank - 3, and the elbow is index + 3
    order = F.when(F.col("fall").isNotNull(), F.struct((-F.col("fall")).alias("f"), F.col("rank").alias("r")))
    found = drops.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min_by("rank", order).alias("at"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    m = F.coalesce("m", F.lit(0))
    k = F.when(F.col("n") < 4, F.col("n")).when(m < 3, m + 2).otherwise(F.col("at"))
    return sizes.join(found, by, "left").select(*by, k.cast("bigint").alias("elbow_k"))


# ---- pairing --------------------------------------------------------------------------------------


def opposite_pairs(
    df: DataFrame,
    gate: str = "semantic",
    by: list[str] = ["category"],
    small: int = SMALL_GROUP,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """Pair off the least similar free words, again and again; an odd word takes its least similar word one-way.

    Returns (by, ordinal, word, opposite, similarity), one row per word of a group of two or more.
    """
    word_t = df.schema["word"].dataType.simpleString()
    little, big = _by_size(df, by, small)
    names = [*by, "ordinal", "word"]

    def solve(table: pa.Table) -> pa.Table:
        block = T.Block(table)
        n = len(block)
        mate, value = np.full(n, -1), np.full(n, np.nan)
        if n >= 2:
            sim = _full(block, gate, 0.5)
            work = np.where(np.tri(n, dtype=bool), np.inf, sim)
            for _ in range(n // 2):
                i, j = np.unravel_index(int(work.argmin()), work.shape)
                mate[i], mate[j], value[i], value[j] = j, i, sim[i, j], sim[i, j]
                work[[i, j], :] = np.inf
                work[:, [i, j]] = np.inf
            for last in np.nonzero(mate < 0)[0]:
                row = sim[last].copy()
                row[last] = np.inf
                mate[last], value[last] = int(row.argmin()), row.min()
        used = pa.array(np.nonzero(mate >= 0)[0])
        t = block.table.select(names).take(used)
        t = t.append_column("opposite", A.plain(block.table.column("word")).take(pa.array(mate[mate >= 0])))
        return t.append_column("similarity", pa.array(value[mate >= 0]))

    out = grouped(little, by).applyInArrow(solve, f"{_ddl(df, names)}, opposite {word_t}, similarity double")
    if big is None:
        return out
    mates = _pair_rounds(big, gate, by, rows)
    words = big.select(*by, F.col("ordinal").alias("mate"), F.col("word").alias("opposite"))
    return out.unionByName(big.select(*names).join(mates, [*by, "ordinal"]).join(words, [*by, "mate"]).select(*names, "opposite", "similarity"))


def _best_classes(active: DataFrame, gate: str, by: list[str], rows: int) -> DataFrame:
    """Per class of equal vectors its least similar partner class, which may be itself.

    ``ordinal`` and ``second`` are the first two free words of a class; edges are ordered by (similarity,
    first, second ordinal).  ``tied`` tells that another edge of the class has the same similarity.
    """
    keys = [*by, "cls"]
    carry = ["ordinal", "free", "used"]
    names = [*keys, *carry, "sim", "mate", "mate_at", "ties"]

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        cls_a, cls_b = A.column(a.table, "cls"), A.column(b.table, "cls")
        low = [np.full(len(x), np.inf) for x in (a, b)]
        mate = [np.zeros(len(x), np.int64) for x in (a, b)]
        at = [np.zeros(len(x), np.int64) for x in (a, b)]
        ties = [np.zeros(len(x), np.int64) for x in (a, b)]
        for strip, sims in T.strips(a, b, [gate], 0.5):
            sim = sims[gate]
            r = np.arange(sim.shape[0])
            if same:
                own = sim[r, r + strip.start].copy()
                sim = np.where(cls_a[strip][:, None] == cls_b[None, :], np.inf, sim)
            # columns are in ordinal order: the first hit has the least partner ordinal
            best = sim.argmin(axis=1)
            v = sim[r, best]
            low[0][strip], mate[0][strip], at[0][strip] = v, cls_b[best], b.ordinal[best]
            ties[0][strip] = (sim == v[:, None]).sum(axis=1)
            if same:  # two words of one class may be paired with each other
                second = A.column(a.table, "second")[strip]
                twice = A.column(a.table, "free")[strip] >= 2
                equal = twice & (own == v)
                first = twice & ((own < v) | (equal & (second < at[0][strip])))
                ties[0][strip] = np.where(equal, ties[0][strip] + 1, np.where(first, 1, ties[0][strip]))
                low[0][strip] = np.where(first, own, v)
                mate[0][strip] = np.where(first, cls_a[strip], mate[0][strip])
                at[0][strip] = np.where(first, second, at[0][strip])
            else:
                best = sim.argmin(axis=0)
                c = np.arange(sim.shape[1])
                v = sim[best, c]
                n = (sim == v[None, :]).sum(axis=0)
                better, equal = v < low[1], v == low[1]
                ties[1] = np.where(better, n, np.where(equal, ties[1] + n, ties[1]))
                low[1] = np.where(better, v, low[1])
                # strips come in ordinal order, so an equal later hit has a larger ordinal
                mate[1] = np.where(better, cls_a[strip][best], mate[1])
                at[1] = np.where(better, a.ordinal[strip][best], at[1])
        out = []
        for side, block in enumerate((a, b)[: 1 if same else 2]):
            ok = np.nonzero(np.isfinite(low[side]))[0]
            t = block.table.select([*keys, *carry]).take(pa.array(ok))
            for n, x in (("sim", low), ("mate", mate), ("mate_at", at), ("ties", ties)):
                t = t.append_column(n, pa.array(x[side][ok]))
            out.append(t.select(names))
        return pa.concat_tables(out)

    tiled = T.self_tiles(active, by, "cls", rows)
    head = _ddl(active, [*keys, *carry])
    parts = T.per_tile(tiled, by, kernel, f"{head}, sim double, mate bigint, mate_at bigint, ties bigint")
    merged = parts.groupBy(*keys, *carry).agg(
        F.min_by(F.struct("sim", "mate", "ties"), F.struct("sim", "mate_at")).alias("b"),
        F.collect_list("sim").alias("sims"),  # one value per tile
    )
    tied = (F.col("b.ties") > 1) | (F.size(F.filter("sims", lambda x: x == F.col("b.sim"))) > 1)
    return merged.select(*keys, *carry, "b.sim", "b.mate", tied.alias("tied"))


def _partner_lists(active: DataFrame, gate: str, by: list[str], rows: int, k: int) -> DataFrame:
    """Per class its ``k`` least similar partner classes, which may include itself; fewer only where there are fewer."""
    keys = [*by, "cls"]
    names = [*keys, "free", "used"]
    edge = pa.struct([("sim", pa.float64()), ("mate", pa.int64())])

    def least(a: T.Block, b: T.Block, same: bool) -> pa.Table:
        free, mates = A.column(a.table, "free"), A.column(b.table, "cls")
        sim, mate, size = [], [], []
        for strip, sims in T.strips(a, b, [gate], 0.5):
            m = sims[gate]
            if same:  # two words of one class may be paired with each other
                m, r = m.copy(), np.arange(m.shape[0])
                m[r, r + strip.start] = np.where(free[strip] >= 2, m[r, r + strip.start], np.inf)
            at = np.argpartition(m, k - 1, axis=1)[:, :k] if m.shape[1] > k else np.broadcast_to(np.arange(m.shape[1]), m.shape)
            v = np.take_along_axis(m, at, 1)
            ok = np.isfinite(v)
            sim.append(v[ok])
            mate.append(mates[at[ok]])
            size.append(ok.sum(1))
        sim, mate, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sim, mate, size))
        held = pa.StructArray.from_arrays([pa.array(sim, pa.float64()), pa.array(mate, pa.int64())], fields=list(edge))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return a.table.select(names).append_column("e", pa.ListArray.from_arrays(pa.array(offsets), held))

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        return least(a, a, True) if same else pa.concat_tables([least(a, b, False), least(b, a, False)])

    tiled = T.self_tiles(active, by, "cls", rows)
    parts = T.per_tile(tiled, by, kernel, f"{_ddl(active, names)}, e array<struct<sim:double,mate:bigint>>")
    return parts.groupBy(*names).agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, k).alias("e"))


def _listed_picks(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """The greedy choices that lists of ``k`` partners prove: (by, x, y, similarity, used_x, used_y, take).

    Listed edges are walked from the least similar.  A class knows all its edges below the last of a full list, so an
    edge below that of both classes, met while both are free, is the next choice.  A class that meets an edge which is
    not, or one of equal similarity beside another, is left for the next round, and so are all that meet it later.
    """
    cols = [*by, "x", "y", "similarity", "used_x", "used_y", "take"]

    def solve(table: pa.Table) -> pa.Table:
        cls = A.column(table, "cls")
        order = np.argsort(cls)
        cls, free, used = cls[order], A.column(table, "free")[order].tolist(), A.column(table, "used")[order].tolist()
        e = A.plain(table.column("e")).take(pa.array(order))
        size, flat = np.diff(e.offsets.to_numpy()), e.flatten()
        sim = flat.field("sim").to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        # a list is in the order of similarity
        known = np.where(size < k, np.inf, sim[np.maximum(ends - 1, 0)] if len(sim) else np.inf).tolist()
        x = np.repeat(np.arange(len(cls)), size)
        mates = flat.field("mate").to_numpy(zero_copy_only=False)
        y = np.searchsorted(cls, mates)
        x, y = np.minimum(x, y), np.maximum(x, y)
        by_edge = np.lexsort((sim, y, x))
        x, y, sim = x[by_edge], y[by_edge], sim[by_edge]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y, sim = x[new], y[new], sim[new]
        walk = np.argsort(sim, kind="stable")
        x, y, sim = x[walk].tolist(), y[walk].tolist(), sim[walk].tolist()
        stuck = [False] * len(cls)
        got = []
        at = 0
        while at < len(x):
            end = at + 1
            while end < len(x) and sim[end] == sim[at]:
                end += 1
            live = [i for i in range(at, end) if free[x[i]] >= (2 if x[i] == y[i] else 1) and free[y[i]]]
            at = end
            met: dict[int, int] = {}
            if len(live) > 1:
                for i in live:
                    for c in {x[i], y[i]}:
                        met[c] = met.get(c, 0) + 1
            for i in live:
                a, b, s = x[i], y[i], sim[i]
                if stuck[a] or stuck[b] or s >= known[a] or s >= known[b] or met.get(a, 1) > 1 or met.get(b, 1) > 1:
                    stuck[a] = stuck[b] = True
                    continue
                take = free[a] // 2 if a == b else min(free[a], free[b])
                got.append((a, b, s, used[a], used[b], take))
                for c, n in ((a, 2 * take),) if a == b else ((a, take), (b, take)):
                    free[c], used[c] = free[c] - n, used[c] + n
        p = list(zip(*got)) if got else [()] * 6
        head = [pa.array([table.column(c)[0].as_py()] * len(got), table.schema.field(c).type) for c in by]
        i64 = lambda v: pa.array(np.asarray(v, np.int64))
        who = lambda v: i64(cls[np.asarray(v, np.int64)])
        return pa.table([*head, who(p[0]), who(p[1]), pa.array(p[2], pa.float64()), i64(p[3]), i64(p[4]), i64(p[5])], names=cols)

    schema = ", ".join([*([_ddl(lists, by)] if by else []), "x bigint, y bigint, similarity double, used_x bigint, used_y bigint, take bigint"])
    if by:
        return grouped(lists, by).applyInArrow(solve, schema)
    return lists.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(solve, schema)


def _pair_rounds(df: DataFrame, gate: str, by: list[str], rows: int) -> DataFrame:
    """(by, ordinal, mate, similarity) for large groups.

    Each round takes all choices that lists of least similar partners prove (:func:`_listed_picks`); of a group of more
    classes than such lists fit, and where they prove nothing, those that are mutually best.

    Words with equal vectors form a class, of which only the number of used words is tracked.  A pair of
    classes that are each other's best is also the next greedy choice among its neighbours, so all such
    pairs are taken at once, and as long as no other edge has the same similarity, the free words of both
    classes are paired off in order until one class is used up.
    """
    keys = [*by, "cls"]
    flat = F.coalesce("semantic", F.array().cast("array<double>"))
    work = df.select(*by, "ordinal", "visual", "semantic")
    named = work.withColumn("_s", flat)
    classes = cut(
        named.groupBy(*by, "visual", "_s").agg(F.min("ordinal").alias("cls"), F.count(F.lit(1)).alias("n"), F.first("semantic").alias("semantic"))
    )
    members = named.select(*by, "visual", "_s", "ordinal").join(classes.select(*by, "visual", "_s", "cls"), [*by, "visual", "_s"])
    members = cut(dense_index(members.select(*keys, "ordinal"), keys, "ordinal", "pos"))
    state = classes.select(*keys, "n", "visual", "semantic").withColumn("used", F.lit(0).cast("bigint"))
    taken: list[DataFrame] = []
    wait = rest = 0  # rounds without lists after lists that proved nothing, doubled each time
    while True:
        live = state.filter("used < n")
        k = min(LISTED, LISTED_EDGES // max(T.peak_rows(live, by), 1))
        if k >= 2 and not rest:
            active = live.select(*keys, F.col("cls").alias("ordinal"), (F.col("n") - F.col("used")).alias("free"), "used", "visual", "semantic")
            picks = cut(_listed_picks(_partner_lists(active, gate, by, rows, k), by, k))
            if not picks.isEmpty():
                taken.append(picks)
                state, wait = _spent(live, picks, keys), 0
                continue
            wait = rest = 2 * wait or 1
        rest = max(rest - 1, 0)
        ahead = live.select(*keys, F.explode(F.array(F.col("used") + 1, F.col("used") + 2)).alias("pos"))
        heads = ahead.join(members, [*keys, "pos"]).groupBy(*keys).agg(F.min("ordinal").alias("ordinal"), F.max("ordinal").alias("second"))
        active = live.join(heads, keys).select(*keys, "ordinal", "second", (F.col("n") - F.col("used")).alias("free"), "used", "visual", "semantic")
        best = cut(_best_classes(active, gate, by, rows))
        if best.isEmpty():
            break
        edges = best.groupBy(*by, F.least("cls", "mate").alias("x"), F.greatest("cls", "mate").alias("y")).agg(
            F.count(F.lit(1)).alias("c"), F.min("sim").alias("similarity"), F.array_sort(F.collect_list(F.struct("cls", "used", "free", "tied"))).alias("s"),  # one or two entries
        )
        a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
        alone = F.col("x") == F.col("y")
        many = F.when(alone, F.floor(a["free"] / 2)).otherwise(F.least(a["free"], b["free"]))
        one_by_one = a["tied"] | F.coalesce(b["tied"], F.lit(False))
        picks = cut(
            edges.filter(alone | (F.col("c") == 2)).select(
                *by, "x", "y", "similarity", a["used"].alias("used_x"), F.coalesce(b["used"], a["used"]).alias("used_y"),
                F.when(one_by_one, F.lit(1)).otherwise(many).cast("bigint").alias("take"),
            )
        )
        taken.append(picks)
        state = _spent(live, picks, keys)
    mates: list[DataFrame] = []
    if taken:
        picks = taken[0]
        for t in taken[1:]:
            picks = picks.unionByName(t)
        # long runs are cut into blocks that spread over the cluster before they are written out
        block = 1 << 16
        runs = picks.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("take") - 1) / block)))).repartition(*by, "x", "y", "_b")
        each = runs.withColumn("k", F.explode(F.sequence(F.col("_b") * block + 1, F.least("take", (F.col("_b") + 1) * block))))
        alone = F.col("x") == F.col("y")
        at = each.select(
            *by, "x", "y", "similarity",
            F.when(alone, F.col("used_x") + 2 * F.col("k") - 1).otherwise(F.col("used_x") + F.col("k")).alias("px"),
            F.when(alone, F.col("used_x") + 2 * F.col("k")).otherwise(F.col("used_y") + F.col("k")).alias("py"),
        )
        who = lambda c, p, o: _renewed(members.select(*by, F.col("cls").alias(c), F.col("pos").alias(p), F.col("ordinal").alias(o)))
        both = at.join(who("x", "px", "i"), [*by, "x", "px"]).join(who("y", "py", "j"), [*by, "y", "py"])
        two = F.explode(F.array(F.struct(F.col("i").alias("ordinal"), F.col("j").alias("mate")), F.struct(F.col("j").alias("ordinal"), F.col("i").alias("mate"))))
        mates.append(both.select(*by, two.alias("p"), "similarity").select(*by, "p.ordinal", "p.mate", "similarity"))
    # at most one word per group is left: its partner may be any word of the group
    if not state.isEmpty():
        last = state.select(*keys, (F.col("used") + 1).alias("pos")).join(members, [*keys, "pos"]).select(*by, "ordinal")
        mates.append(cut(best_partners_of(cut(work.join(last, [*by, "ordinal"])), work, gate, by, rows)))
    out = mates[0]
    for t in mates[1:]:
        out = out.unionByName(t)
    return out


def _spent(live: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """The classes that still have free words after ``picks``."""
    by, twice = keys[:-1], F.col("x") == F.col("y")
    ends = F.array(*[F.struct(F.col(c).alias("cls"), F.when(twice, F.lit(2 if c == "x" else 0)).otherwise(1).alias("each")) for c in ("x", "y")])
    spent = picks.select(*by, "take", F.explode(ends).alias("p")).groupBy(*by, F.col("p.cls").alias("cls")).agg(F.sum(F.col("take") * F.col("p.each")).alias("more"))
    return cut(live.join(spent, keys, "left").withColumn("used", F.col("used") + F.coalesce("more", F.lit(0))).drop("more").filter("used < n"))


def best_partners_of(lone: DataFrame, work: DataFrame, gate: str, by: list[str], rows: int) -> DataFrame:
    """Least similar word of the group for single rows: the group is visited tile by tile."""
    keys = [*by, "ordinal"]
    sizes = work.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_tiles"))
    tiles = work.join(sizes, by).withColumn("_tile", F.pmod(F.xxhash64("ordinal"), F.col("_tiles")).cast("int"))
    one = lone.join(sizes, by).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))

    def kernel(tile: pa.Table, single: pa.Table) -> pa.Table:
        names = [*keys, "mate", "similarity"]
        if not single.num_rows or not tile.num_rows:
            return pa.table([A.plain(tile.column(c)).slice(0, 0) for c in keys] + [pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        a, b = T.Block(single), T.Block(tile)
        (_, sims), = list(T.strips(a, b, [gate], 0.5))
        row = np.where(b.ordinal == a.ordinal[0], np.inf, sims[gate][0])
        at = int(row.argmin())
        if not np.isfinite(row[at]):
            return pa.table([A.plain(tile.column(c)).slice(0, 0) for c in keys] + [pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        return pa.table([A.plain(a.table.column(c)) for c in keys] + [pa.array([int(b.ordinal[at])]), pa.array([float(row[at])])], names=names)

    cols = [*keys, "_tile", "visual", "semantic"]
    parts = tiles.select(*cols).groupBy(*by, "_tile").cogroup(_renewed(one.select(*cols)).groupBy(*by, "_tile")).applyInArrow(
        kernel, f"{_ddl(work, keys)}, mate bigint, similarity double"
    )
    got = parts.groupBy(*keys).agg(F.min_by(F.struct("mate", "similarity"), F.struct("similarity", "mate")).alias("b"))
    return got.select(*keys, "b.mate", "b.similarity")


def distant_pairs(df: DataFrame, n_pairs: int, gate: str = "semantic", rows: int = T.TILE_ROWS) -> DataFrame:
    """The greedy list of least similar pairs from different categories, each word used once.

    While fewer than n pairs are chosen, fewer than 2n words are used; so a chosen pair is among the 2n
    least similar partners of both its words.  Only such mutual pairs can be chosen, a used word touches
    at most 2n of them, and the n-th choice is therefore among the first 4n^2 + n in order.  Each tile
    pair applies the same bound to its own rows, so its output is bounded too.

    A table of more than a tile is searched through cells.  The most promising ones give 2n - 1 pairs without a common
    word; n - 1 choices can take words from 2n - 2 of them at most, so no choice is more similar than the last of these,
    and only cells whose bounds reach down to it are compared.
    """
    need = df.select("category", "ordinal", "word", "visual", "semantic")
    rows = min(rows, 2048)
    if n_pairs <= 0 or T.peak_rows(need, []) <= rows:
        return _distant(T.self_tiles(need, [], "ordinal", rows), need, n_pairs, gate, T.per_tile)
    index = Cells(need, "ordinal", rows)
    apart = _distant(index.tiles(need, [], gate, None, True), need, 2 * n_pairs - 1, gate, per_tile)
    values = [r.similarity for r in apart.select("similarity").collect()]  # 2n - 1 rows
    bound = max(values) if len(values) == 2 * n_pairs - 1 else float("inf")
    return _distant(index.tiles(need, [], gate, bound, True), need, n_pairs, gate, per_tile, bound)


def _distant(laid: DataFrame, need: DataFrame, n_pairs: int, gate: str, per, limit: float = float("inf")) -> DataFrame:
    """The greedy list over the pairs of a layout that are no more similar than ``limit``."""
    from pyspark.sql import Window

    near, bound = 2 * n_pairs, 4 * n_pairs * n_pairs + n_pairs
    word_t, cat_t = (need.schema[c].dataType.simpleString() for c in ("word", "category"))
    schema = f"i bigint, j bigint, sim double, word_i {word_t}, word_j {word_t}, category_i {cat_t}, category_j {cat_t}"

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        found: list[tuple] = []
        for strip, sims in T.strips(a, b, [gate], 0.5):
            ok = A.column(a.table, "category")[strip][:, None] != A.column(b.table, "category")[None, :]
            if same:
                ok &= np.arange(len(b))[None, :] != (np.arange(strip.stop - strip.start) + strip.start)[:, None]
            # columns are in ordinal order, so a stable sort breaks ties as the total order of pairs does
            sim = np.where(ok & (sims[gate] <= limit), sims[gate], np.inf)
            many = np.flatnonzero(np.isfinite(sim).sum(1) > near)
            if len(many):
                last = np.argsort(sim[many], axis=1, kind="stable")[:, near:]
                sim[many[:, None], last] = np.inf
            x, y = np.nonzero(np.isfinite(sim))
            found.append((x + strip.start, y, sim[x, y]))
        r, c, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # of what the rows left, the lowest of each column: no choice is lost, and a word still has 2n edges at most
        by_column = np.lexsort((r, v, c))
        c_sorted = c[by_column]
        rank = np.arange(len(c)) - np.searchsorted(c_sorted, c_sorted)
        keep = by_column[rank < near]
        keep = np.sort(keep[r[keep] < c[keep]] if same else keep)
        r, c, v = r[keep], c[keep], v[keep]
        oi, oj = a.ordinal[r], b.ordinal[c]
        swap = oi > oj
        order = np.lexsort((np.maximum(oi, oj), np.minimum(oi, oj), v))
        order = order[:bound]
        r, c, v, swap = (x[order] for x in (r, c, v, swap))

        def side(name):
            x = A.plain(a.table.column(name)).take(pa.array(r))
            y = A.plain(b.table.column(name)).take(pa.array(c))
            m = pa.array(swap, pa.bool_())
            return pc.if_else(m, y, x), pc.if_else(m, x, y)

        (i, j), (wi, wj), (ci, cj) = side("ordinal"), side("word"), side("category")
        return pa.table([i.cast(pa.int64()), j.cast(pa.int64()), pa.array(v), wi, wj, ci, cj],
                        names=["i", "j", "sim", "word_i", "word_j", "category_i", "category_j"])

    edges = per(laid, [], kernel, schema)
    # per word at most 2n rows per tile reach this window
    both = edges.select("*", F.explode(F.array("i", "j")).alias("node"))
    w = Window.partitionBy("node").orderBy("sim", "i", "j")
    listed = both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= near)
    mutual = listed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"), F.first(F.struct("sim", "word_i", "word_j", "category_i", "category_j")).alias("e"))
    short = mutual.filter("c = 2").select("i", "j", "e.*").orderBy("sim", "i", "j").limit(bound)

    def choose(table: pa.Table) -> pa.Table:
        order = np.lexsort((A.column(table, "j"), A.column(table, "i"), A.column(table, "sim")))
        used, rows_ = set(), []
        i, j = A.column(table, "i"), A.column(table, "j")
        for x in order:
            if len(rows_) == n_pairs:
                break
            if i[x] not in used and j[x] not in used:
                used |= {i[x], j[x]}
                rows_.append(int(x))
        t = table.select(["word_i", "word_j", "category_i", "category_j", "sim"]).take(pa.array(rows_, pa.int64()))
        return t.append_column("rank", pa.array(np.arange(1, len(rows_) + 1, dtype=np.int32)))

    return (
        short.withColumn("_all", F.lit(0)).groupBy("_all")
        .applyInArrow(choose, f"word_i {word_t}, word_j {word_t}, category_i {cat_t}, category_j {cat_t}, sim double, rank int")
        .select(F.col("word_i").alias("word_a"), F.col("word_j").alias("word_b"),
                F.col("category_i").alias("category_a"), F.col("category_j").alias("category_b"),
                F.col("sim").alias("similarity"), "rank")
    )
