"""An index of vectors: cells around pivots, with exact bounds on the similarities of a cell's rows.

Pivots are rows of the table, ``PIVOTS`` at most, and each row belongs to the cell of its nearest one.  A cell knows
between which angles from its pivot its rows lie and between which lengths.  By the triangle inequality of angles no row
of a cell can be more similar to a vector than :meth:`Balls.bounds` says, nor less; so cells that cannot hold an
answer are skipped, and what is left is compared in full.  Nothing is approximate: only pairs of rows that cannot count
are never made.  Where the data have no structure the bounds skip nothing, and the work is that of plain tiles.

What is broadcast is one vector a cell and space, of at most ``PIVOT_BYTES``, whatever the table's size; a cell of more
than a tile's rows is dealt into parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arrow as A
from ..session import cut
from . import tiles as T

PIVOTS, PIVOT_BYTES = 4096, 16 << 20
#: Angles are rounded; a bound is widened by this much.
SLACK = 1e-6
PART_BITS = 20
PROBES = 1024  # rows whose visits are counted before a layout is chosen
TAKEN_ROWS = 8192  # rows of one batch of visits
SPACES = ("visual", "semantic")


@dataclass
class Balls:
    """The cells, by space: unit pivots (P, d), least and greatest angle and length of the rows (P each)."""

    pivots: dict[str, np.ndarray]
    angles: dict[str, tuple[np.ndarray, np.ndarray]]
    lengths: dict[str, tuple[np.ndarray, np.ndarray]]
    missing: np.ndarray  # cells with a row that has no semantic vector
    used: np.ndarray  # cells with rows

    def one(self, m: np.ndarray, space: str) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) product of each row of ``m`` with any row of each cell."""
        size = np.linalg.norm(m, axis=1)[:, None]
        mine = _angles(m, self.pivots[space])
        (near, far), (short, long) = self.angles[space], self.lengths[space]
        least = np.maximum(np.maximum(mine - far, near - mine) - SLACK, 0)
        most = np.minimum(mine + far + SLACK, np.pi)
        high, low = np.cos(least), np.cos(most)
        extra = SLACK * size * long
        return size * np.where(low > 0, short, long) * low - extra, size * np.where(high > 0, long, short) * high + extra

    def bounds(self, vectors: dict[str, tuple[np.ndarray, np.ndarray]], gate: str, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) similarity under ``gate`` of each row with any row of each cell.

        ``vectors`` has a matrix and a mask of present rows for each space.  Where one of two rows has no semantic
        vector, the visual similarity stands for the semantic one.
        """
        low, high = self.one(vectors["visual"][0], "visual")
        if gate == "visual" or "semantic" not in vectors:
            return low, high
        m, has = vectors["semantic"]
        either = self.missing[None, :] | ~has[:, None]
        if m is None:
            low_t, high_t = low, high
        else:
            low_t, high_t = self.one(m, "semantic")
            low_t = np.where(has[:, None], np.where(either, np.minimum(low, low_t), low_t), low)
            high_t = np.where(has[:, None], np.where(either, np.maximum(high, high_t), high_t), high)
        if gate == "semantic":
            return low_t, high_t
        if gate == "either_similar":
            return np.maximum(low, low_t), np.maximum(high, high_t)
        if gate == "either_distinct":
            return np.minimum(low, low_t), np.minimum(high, high_t)
        if gate == "gap":
            return low - high_t, high - low_t
        if gate == "joint":
            a, b = alpha * low + (1 - alpha) * low_t, alpha * high + (1 - alpha) * high_t
            return np.minimum(a, np.where(either, low, a)), np.maximum(b, np.where(either, high, b))
        raise ValueError(f"unknown gate {gate}")


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1)
    unit = m / np.where(size > 0, size, 1.0)[:, None]
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _vectors(b: pa.RecordBatch, spaces: tuple[str, ...]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {s: A.matrix(b.column(b.schema.get_field_index(s))) for s in spaces}


def _nearest(vectors, pivots: dict[str, np.ndarray]) -> np.ndarray:
    """The pivot of least summed angles; a missing space counts as the other."""
    total = _angles(vectors["visual"][0], pivots["visual"])
    if "semantic" in vectors:
        m, has = vectors["semantic"]
        total = total + (np.where(has[:, None], _angles(m, pivots["semantic"]), total) if m is not None else total)
    return total.argmin(1)


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, limit):
            yield b.slice(at, limit)


class Cells:
    """The index of a table: its pivots and balls; :attr:`cells` of how many it has."""

    def __init__(self, df: DataFrame, key: str, rows: int = T.TILE_ROWS, cells: int | None = None, semantic: bool = True):
        """``df`` has ``key`` (unique), ``visual`` (not null) and, with ``semantic``, ``semantic`` (may be null)."""
        self.key, self.rows = key, rows
        self._judged: dict[tuple, bool] = {}
        self.spaces = SPACES if semantic else SPACES[:1]
        sizes = df.agg(F.count(F.lit(1)), *[F.max(F.size(s)) for s in self.spaces]).first()
        self.n, dims = int(sizes[0]), [max(int(x or 0), 1) for x in sizes[1:]]
        want = cells or math.ceil(self.n / rows)
        self.cells = max(1, min(want, PIVOTS, PIVOT_BYTES // (8 * sum(dims)), max(self.n, 1)))
        self.balls = self._balls(df, self._pivots(df, dims))

    def _pivots(self, df: DataFrame, dims: list[int]) -> dict[str, np.ndarray]:
        t = df.select(self.key, *self.spaces).orderBy(F.xxhash64(self.key), self.key).limit(self.cells).toArrow()
        out = {}
        for s, d in zip(self.spaces, dims, strict=True):
            m, has = A.matrix(t.column(s)) if t.num_rows else (None, None)
            m = np.zeros((max(t.num_rows, 1), d)) if m is None else np.where(has[:, None], m, 0.0)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            out[s] = m / np.where(size > 0, size, 1.0)
        self.cells = len(out["visual"])
        return out

    def _balls(self, df: DataFrame, pivots: dict[str, np.ndarray]) -> Balls:
        held = df.sparkSession.sparkContext.broadcast(pivots)
        spaces = self.spaces

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = held.value
            k = len(p["visual"])
            low = {s: (np.full(k, np.inf), np.full(k, np.inf)) for s in spaces}
            high = {s: (np.full(k, -np.inf), np.full(k, -np.inf)) for s in spaces}
            missing, used = np.zeros(k, bool), np.zeros(k, bool)
            for b in _pieces(batches, 2048):
                v = _vectors(b, spaces)
                cell = _nearest(v, p)
                used[cell] = True
                for s in spaces:
                    m, has = v[s]
                    missing[cell[~has]] = True
                    if m is None:
                        continue
                    m, at = m[has], cell[has]
                    angle, size = _angles_own(m, p[s][at]), np.linalg.norm(m, axis=1)
                    for x, (lo, hi) in ((angle, (low[s][0], high[s][0])), (size, (low[s][1], high[s][1]))):
                        np.minimum.at(lo, at, x)
                        np.maximum.at(hi, at, x)
            cells = np.flatnonzero(used)
            cols = [pa.array(cells), pa.array(missing[cells])]
            cols += [pa.array(x[cells]) for s in spaces for x in (low[s][0], high[s][0], low[s][1], high[s][1])]
            yield pa.RecordBatch.from_arrays(cols, names)

        stats = [f"{s}_{x}" for s in spaces for x in ("near", "far", "short", "long")]
        names = ["cell", "missing", *stats]
        parts = df.select(*spaces).mapInArrow(measure, "cell long, missing boolean, " + ", ".join(f"{c} double" for c in stats))
        how = {"near": F.min, "short": F.min, "far": F.max, "long": F.max}
        rows = parts.groupBy("cell").agg(F.max("missing").alias("missing"), *[how[c.split("_")[1]](c).alias(c) for c in stats]).collect()
        k = len(pivots["visual"])
        got = {c: np.zeros(k) for c in stats}
        missing, used = np.zeros(k, bool), np.zeros(k, bool)
        for r in rows:
            used[r.cell], missing[r.cell] = True, r.missing
            for c in stats:
                got[c][r.cell] = r[c] if math.isfinite(r[c]) else 0.0
        pair = lambda s, a, b: (got[f"{s}_{a}"], got[f"{s}_{b}"])
        return Balls(pivots, {s: pair(s, "near", "far") for s in spaces}, {s: pair(s, "short", "long") for s in spaces}, missing, used)

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_cell``."""
        held, spaces = df.sparkSession.sparkContext.broadcast(self.balls.pivots), self.spaces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches, 2048):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(_vectors(b, spaces), held.value).astype(np.int32))], [*b.schema.names, "_cell"])

        return df.mapInArrow(run, _ddl(df) + ", _cell int")

    def visits(self, df: DataFrame, gate: str, bound: float | str | None, below: bool = False, alpha: float = 0.5) -> DataFrame:
        """``df`` (with ``_cell``) once for each cell ``_other`` that may hold a row whose similarity is at least
        ``bound`` (with ``below``: at most), a number or a column's name (null: every cell), and for its own cell.  Without
        a bound, only for the cell that promises most and its own."""
        held, spaces = df.sparkSession.sparkContext.broadcast(self.balls), self.spaces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            balls = held.value
            for b in _pieces(batches, 1024):
                low, high = balls.bounds(_vectors(b, spaces), gate, alpha)
                if isinstance(bound, str):
                    limit = b.column(b.schema.get_field_index(bound)).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                else:
                    limit = bound
                rows = np.arange(b.num_rows)
                if bound is None:
                    may = np.zeros(low.shape, bool)
                    may[rows, np.where(balls.used, low, np.inf).argmin(1) if below else np.where(balls.used, high, -np.inf).argmax(1)] = True
                else:
                    may = ~(low > limit) if below else ~(high < limit)  # a missing bound lets all pass
                may &= balls.used[None, :]
                may[rows, b.column(b.schema.get_field_index("_cell")).to_numpy(zero_copy_only=False)] = True
                row, other = np.nonzero(may)
                for at in range(0, len(row), TAKEN_ROWS):  # a batch of rows may visit thousands of cells each
                    got = b.take(pa.array(row[at : at + TAKEN_ROWS]))
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array(other[at : at + TAKEN_ROWS].astype(np.int32))], [*got.schema.names, "_other"])

        return df.mapInArrow(run, _ddl(df) + ", _other int")

    def plain(self, some: DataFrame, gate: str, bound: float | str, below: bool = False, alpha: float = 0.5) -> bool:
        """Whether plain tiles cost less than visits by cells, judged by the visits of ``some`` rows (with ``_cell``).

        A row goes into a pair of tiles for each cell it visits, or for each tile of the plain layout.  Where the bounds
        skip little, visits only shuffle more; where they skip much, a few times the shuffle is worth it.
        """
        plain = math.ceil(self.n / T.fitted(some, self.rows, self.n))
        if self.cells <= plain:
            return False
        seen = self.visits(some.select("_cell", *self.spaces, *([bound] if isinstance(bound, str) else [])), gate, bound, below, alpha)
        rows, made = some.count(), seen.count()
        each = made / max(rows, 1)
        return rows > 0 and (each > 4 * plain or (each > plain and each > self.cells / 4))

    def tiles(self, df: DataFrame, by: list[str], gate: str, bound: float | None, below: bool = False, alpha: float = 0.5) -> DataFrame:
        """The rows laid out for pairs within ``by`` whose similarity can reach ``bound``: as
        :func:`wordloom.operators.tiles.self_tiles` does, without the tiles whose bounds forbid it; without a bound, for
        the most promising pairs only, of which either row may name the other's cell."""
        own = self.assign(df)
        if self._plainly(own, gate, bound, below, alpha):
            return T.self_tiles(df, by, self.key, self.rows)
        if by:
            sizes = own.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.rows)).cast("int").alias("_parts"))
        else:
            sizes = own.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.rows)).cast("int").alias("_parts"))
        sizes = cut(sizes)
        pairs = self.visits(own, gate, bound, below, alpha)
        there = sizes.select(*by, F.col("_cell").alias("_other"), F.col("_parts").alias("_others"))
        pairs = pairs.join(sizes, [*by, "_cell"]).join(there, [*by, "_other"])
        tile = lambda cell, part: F.shiftleft(F.col(cell).cast("long"), PART_BITS) + part
        mine = tile("_cell", F.pmod(F.xxhash64(self.key), F.col("_parts")))
        each = pairs.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_others") - 1)))
        each = each.withColumns({"_own": mine, "_that": tile("_other", F.col("_p"))})
        laid = each.withColumns({"_lo": F.least("_own", "_that"), "_hi": F.greatest("_own", "_that"), "_side": F.when(F.col("_own") <= F.col("_that"), 0).otherwise(1)})
        return laid.drop("_cell", "_other", "_parts", "_others", "_p", "_own", "_that")


    def _plainly(self, own: DataFrame, gate: str, bound: float | None, below: bool, alpha: float) -> bool:
        """:meth:`plain` for a number as bound, asked once."""
        if bound is None or self.cells <= T.MANY_TILES:
            return False
        asked = (gate, bound, below, alpha)
        if asked not in self._judged:
            self._judged[asked] = self.plain(cut(own.orderBy(F.xxhash64(self.key), self.key).limit(PROBES)), gate, bound, below, alpha)
        return self._judged[asked]


def per_tile(laid: DataFrame, by: list[str], kernel, schema: str) -> DataFrame:
    """``kernel`` on every pair of tiles that both have rows; of a layout of :meth:`Cells.tiles` some may not."""
    nothing = to_arrow_schema(laid.sparkSession.createDataFrame([], schema).schema).empty_table()

    def both(table: pa.Table) -> pa.Table:
        side = A.column(table, "_side")
        if table.column("_lo")[0] != table.column("_hi")[0] and (side == side[0]).all():
            return nothing
        return kernel(table)

    return T.per_tile(laid, by, both, schema)


def _angles_own(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1)
    unit = m / np.where(size > 0, size, 1.0)[:, None]
    return np.arccos(np.clip((unit * pivots).sum(1), -1.0, 1.0))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def similar_pairs(df: DataFrame, threshold: float, gate: str = "visual", by: list[str] = ["category"], alpha: float = 0.5, key: str = "ordinal", rows: int = T.TILE_ROWS, cells: int | None = None) -> DataFrame:
    """(by, i, j, similarity): the pairs i < j of one group whose similarity is above ``threshold``, and no others.

    ``df`` has ``ordinal`` (unique), ``visual`` and ``semantic``.  Rows meet only in pairs of cells whose bounds allow the
    threshold, each row of a pair by its own bound.
    """
    work = df.select(*by, F.col(key).alias("ordinal"), "visual", "semantic")
    index = Cells(work, "ordinal", rows, cells)
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def kernel(table: pa.Table) -> pa.Table:
        a, b, same = T.split_sides(table)
        i, j, s = [], [], []
        for strip, sims in T.strips(a, b, [gate], alpha):
            hit = (sims[gate] > threshold) & T.pair_mask(a, b, strip, same)
            x, y = np.nonzero(hit)
            i.append(a.ordinal[strip][x])
            j.append(b.ordinal[y])
            s.append(sims[gate][x, y])
        i, j, s = (np.concatenate(x) if x else np.zeros(0) for x in (i, j, s))
        n = len(i)
        cols = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in by]
        return pa.table([*cols, pa.array(np.minimum(i, j), pa.int64()), pa.array(np.maximum(i, j), pa.int64()), pa.array(s, pa.float64())], [*by, "i", "j", "similarity"])

    laid = index.tiles(work, by, gate, threshold, alpha=alpha)
    return per_tile(laid, by, kernel, (head + ", " if head else "") + "i bigint, j bigint, similarity double")


def compared(laid: DataFrame, by: list[str]) -> int:
    """How many pairs of rows the tiles of a layout compare."""
    sides = laid.groupBy(*by, "_lo", "_hi").agg(F.count(F.when(F.col("_side") == 0, 1)).alias("a"), F.count(F.when(F.col("_side") == 1, 1)).alias("b"))
    pairs = F.when(F.col("b") == 0, F.when(F.col("_lo") == F.col("_hi"), F.col("a") * (F.col("a") - 1) / 2).otherwise(0)).otherwise(F.col("a") * F.col("b"))
    return int(sides.agg(F.sum(pairs)).first()[0] or 0)
