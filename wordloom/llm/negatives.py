"""Hard negatives by Fagin's threshold algorithm, exact on integer scores.

Rows are dealt into blocks of a bounded number of rows, anchors into tiles, by hashes of their ids; every block meets
every tile once for the positives and once for the negatives, so no task depends on how common a label or a vector is.

In a block every dimension is a list sorted by that component.  An anchor reads each list from its high end where its
own component is positive, from the low end where it is negative, and not at all where it is zero.  Rows met so far are
scored by random access; any other row scores at most the threshold, the sum of the anchor's components times the last
values read.  Reading stops once the threshold is strictly below the kth score found, since an equal score with a
smaller id would still win, or below the window's floor.  The best of all blocks are then ranked by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import width

from .common import written
from .whitening import usable

SCALE = 256
BLOCK, TILE = 8192, 1024
#: Depths at which the threshold is compared grow by this factor.
GROW = 4


def prepare(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, v): one row for each id, that of the least label and vector.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), label.cast("long").alias("label"), df[vec_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _whole(vectors: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * x) by row; a shorter vector has zeros behind its last component."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if flat.size and np.abs(flat).max() >= 2.0**53:
        raise OverflowError("a component is too large for exact integer scores")
    out = np.zeros((len(vectors), d))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _packs(rows: DataFrame, name: str, parts: int, d: int, scale: int, extra: str | None = None) -> DataFrame:
    """(``name``, ids, labels, x[, extra]): the rows of each part as one row of packed columns."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        x = _whole(t.column("v").chunk(0), d, scale)
        cols = [pa.array([v], pa.binary()) for v in (t.column("id").to_numpy().tobytes(), t.column("label").to_numpy().tobytes(), x.tobytes())]
        out = [t.column(name).slice(0, 1), *cols]
        if extra:
            out.append(pa.array([t.column(extra).to_pylist()], pa.list_(pa.list_(pa.list_(pa.int64())))))
        return pa.table(out, [name, "ids", "labels", "x", *([extra] if extra else [])])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    schema = f"{name} int, ids binary, labels binary, x binary" + (f", {extra} array<array<array<long>>>" if extra else "")
    return dealt.repartition(min(parts, width(rows.sparkSession)) if parts > 1 else 1, name).groupBy(name).applyInArrow(pack, schema)


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        m = len(ids)
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, 0)
        rank = np.empty(x.shape[::-1], np.int32)
        np.put_along_axis(rank, order.T, np.arange(m, dtype=np.int32)[None, :], 1)
        self.low, self.high = rank, m - 1 - rank
        self.depths = [16]
        while self.depths[-1] < m:
            self.depths.append(self.depths[-1] * GROW)
        self.depths[-1] = max(m, 1)
        self.most = np.abs(x).max(initial=0.0)

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor and depth, what a row not yet met scores at most."""
        at = np.array(self.depths) - 1
        m = len(self.ids)
        limit = np.maximum(anchors, 0) @ self.values[m - 1 - np.minimum(at, m - 1)].T + np.minimum(anchors, 0) @ self.values[np.minimum(at, m - 1)].T
        return limit + 1e-12 * np.abs(limit)  # products beyond 53 bits are rounded; a bound must not be too low

    def met(self, anchor: np.ndarray) -> np.ndarray:
        """At which depth of the anchor's lists each row comes up first; 0 for an anchor of zeros, which reads none."""
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):
            return np.zeros(len(self.ids), np.int32)
        first = [m[k].min(0) for m, k in ((self.high, up), (self.low, down)) if len(k)]
        return first[0] if len(first) == 1 else np.minimum(*first)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * np.abs(anchor).max(initial=0.0) * len(anchor) < 2.0**53:
            return (self.x[rows] @ anchor).astype(np.int64)
        exact = self.x[rows].astype(np.int64).astype(object) @ anchor.astype(np.int64).astype(object)
        return np.array(exact, dtype=np.int64)  # raises where a score leaves 64 bits


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search(block: Lists, anchor: np.ndarray, eligible: np.ndarray, limits: np.ndarray, windows: list[tuple[int, int, int, int]], k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each window (low, of, high, p): the k best eligible rows with ``low * p <= of * score <= high * p``.

    Returns ids and scores by window, and how many rows were scored.  ``windows`` empty means one without bounds.
    """
    met = block.met(anchor)
    mine = np.flatnonzero(eligible)
    met = met[mine]
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, scored = -1, 0
    picks: list[np.ndarray] = []
    for depth, limit in zip(block.depths, limits, strict=True):
        new = mine[(met >= before) & (met < depth)] if before >= 0 else mine[met < depth]
        before = depth
        if len(new):
            got = block.scores(new, anchor)
            scored += len(new)
            if windows:  # what no window takes need not be kept
                take = np.zeros(len(new), bool)
                for low, of, high, p in windows:
                    take |= (low * p <= of * got) & (of * got <= high * p)
                new, got = new[take], got[take]
            ids, scores = np.concatenate([ids, block.ids[new]]), np.concatenate([scores, got])
        picks, done = [], True
        for low, of, high, p in windows or [(0, 0, 0, 0)]:
            inside = np.flatnonzero((low * p <= of * scores) & (of * scores <= high * p))
            best = inside[_best(ids[inside], scores[inside], k)]
            picks.append(best)
            full = len(best) == k and limit < scores[best[-1]]
            done &= full or bool(windows) and (of * limit < low * p or low * p > high * p)
        if done:
            break
    return [ids[b] for b in picks], [scores[b] for b in picks], scored


def _meet(blocks: DataFrame, tiles: DataFrame, n_blocks: int, n_tiles: int, kernel, schema: str) -> DataFrame:
    """``kernel`` on every block and tile; each pair is one row of one task."""
    n = min(n_blocks * n_tiles, width(blocks.sparkSession))
    left = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    right = tiles.toDF(*[c if c == "tile" else f"a_{c}" for c in tiles.columns]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = left.repartition(n, "tile", "block").join(right.repartition(n, "tile", "block"), ["tile", "block"])
    return both.mapInArrow(kernel, schema)


def _pair(b: pa.RecordBatch, r: int, d: int):
    get = lambda c: b.column(b.schema.get_field_index(c))[r].as_buffer()
    block = Lists(np.frombuffer(get("ids"), np.int64), np.frombuffer(get("labels"), np.int64), np.frombuffer(get("x"), np.float64).reshape(-1, d))
    return block, np.frombuffer(get("a_ids"), np.int64), np.frombuffer(get("a_labels"), np.int64), np.frombuffer(get("a_x"), np.float64).reshape(-1, d)


def mine(df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, of: int = 100, high: int = 100, scale: int = SCALE, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``, ``label`` a column of whole numbers of ``df``.  A score is the
    product of two vectors of ``floor(scale * x)``; a shorter vector has zeros behind its end.  The positives of an
    anchor are the ``positives`` best other rows of its label; each has up to ``negatives`` rows of other labels whose
    score is between ``low / of`` and ``high / of`` of its own.  Ties go to smaller ids.  Rows with a null id, label,
    vector or component, or one that is not finite, take no part; rows of one id count once (the least label and vector);
    an empty table, one label only, or anchors without another row of their label give no rows.  Other columns of ``df``
    are not read.
    """
    rows = written(prepare(df, id_col, vec_col, label), "vectors")
    is_anchor = F.coalesce(anchors, F.lit(False))
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.max(F.size("v")).alias("d")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count.a:
        return df.sparkSession.createDataFrame([], schema)
    n_blocks, n_tiles, d = math.ceil(count.n / block), math.ceil(count.a / tile), count.d
    blocks = written(_packs(rows, "block", n_blocks, d, scale), "blocks")
    some = rows.where(is_anchor)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lists, ids, labels, x = _pair(b, r, d)
                limits, out = lists.thresholds(x), []
                of_label = {v: lists.labels == v for v in np.unique(labels).tolist()}
                for k in range(len(ids)):
                    eligible = of_label[int(labels[k])] & (lists.ids != ids[k])
                    if eligible.any():
                        found, scores, _ = search(lists, x[k], eligible, limits[k], [], positives)
                        out.append((np.full(len(found[0]), ids[k]), found[0], scores[0]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "score"])

    def best(found: DataFrame, by: list[str], other: str, score: str, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    found = _meet(blocks, written(_packs(some, "tile", n_tiles, d, scale), "anchors"), n_blocks, n_tiles, same, "anchor_id long, positive_id long, score long")
    chosen = best(found, ["anchor_id"], "positive_id", "score", positives)
    chosen = chosen.groupBy("anchor_id").agg(F.collect_list(F.array("positive_id", "score")).alias("pairs"))
    asked = some.join(chosen, some["id"] == chosen["anchor_id"]).select("id", "label", "v", "pairs")
    tiles = written(_packs(asked, "tile", n_tiles, d, scale, "pairs"), "anchors")

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lists, ids, labels, x = _pair(b, r, d)
                limits, out = lists.thresholds(x), []
                of_label = {v: lists.labels != v for v in np.unique(labels).tolist()}
                for k, pairs in enumerate(b.column(b.schema.get_field_index("a_pairs"))[r].as_py()):
                    windows = [(low, of, high, p) for _, p in pairs]
                    found, scores, _ = search(lists, x[k], of_label[int(labels[k])], limits[k], windows, negatives)
                    for (positive, p), i, s in zip(pairs, found, scores, strict=True):
                        out.append((np.full(len(i), ids[k]), np.full(len(i), positive), i, np.full(len(i), p), s))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _meet(blocks, tiles, n_blocks, n_tiles, other, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return best(found, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
