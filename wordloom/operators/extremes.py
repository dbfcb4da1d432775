"""Mean, least and greatest similarity over all pairs of a group, without meeting all pairs.

The mean comes from vector sums.  The extremes are searched: a vector is known by its first ``COORDS`` coordinates in a
basis in which the vectors vary most, and by the length of what is left.  For x = (p, q) and y = (p', q') the product is
at least p.p' - |q||q'| and at most p.p' + |q||q'|, so few pairs can beat the best one found so far; only these are
compared in full, in doubles.  Rows of a group are dealt into cells of near coordinates and, inside a cell, into leaves
of ``LEAF_ROWS`` rows with the ranges of their coordinates, which rule most leaves out for most rows.

The basis and the cells come from a sample of ``SAMPLE_ROWS`` rows.  They decide how much is skipped, not what is found:
every row is indexed, and every pair is compared or ruled out by a bound.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..session import cut, fresh_path, width
from .moments import _ddl, _groups, vector_sums
from .pairs import pair_stats

COORDS, FEW = 32, 16  # coordinates of a vector, besides the length of the rest; those that all pairs of a leaf meet by
LEAF_ROWS = 64
STRIP_ROWS, STRIP_LEAVES = 2048, 16  # what is multiplied at once, into the same memory
SPLIT = 9  # coordinates that cells and leaves are cut by: those of the greatest lengths
TILE_ROWS = 32_768  # rows of a cell, at most: coordinates of 4 MB
SAMPLE_ROWS = 4096
HELD_BYTES = 32 << 20  # vectors of one file
READ_ROWS = 128  # rows of a file that are read at once
CHECKED = 64  # pairs that are compared in full at once
FIRST_PAIRS = 3  # pairs of cells, per group and end, that give the first extremes
SLACK = 1e-5  # coordinates are floats: a bound is widened by this much of the lengths' product
LENGTHS = (1e-12, 1e12)  # lengths that floats hold with room for products
SPACES = {"visual": ("visual",), "semantic": ("semantic",), "joint": ("visual", "semantic")}


@dataclass
class Spread:
    """``groups`` and ``whole``: count, pairs, mean_similarity, min_similarity and max_similarity per gate, of each group
    and of all rows; ``sums`` has the vector sums of each group as :func:`wordloom.operators.moments.vector_sums`."""

    groups: DataFrame
    whole: DataFrame | None
    sums: DataFrame


STATS = ["gate", "count", "pairs", "mean_similarity", "min_similarity", "max_similarity"]


def pair_spread(df: DataFrame, by: list[str], gates: list[str], alpha: float = 0.5, whole: bool = False,
                rows: int = TILE_ROWS, leaf: int = LEAF_ROWS) -> Spread:
    """The spread within each group of ``by`` and, with ``whole``, over all rows, as
    :func:`wordloom.operators.pairs.pair_stats` has it, where gates are visual, semantic or joint.

    ``df`` has ``by``, ``ordinal``, ``word``, ``visual`` and ``semantic``, and is read once.  Where a row lacks a vector,
    or lengths are beyond floats, the pairs are met one by one.
    """
    if not set(gates) <= set(SPACES) or ("joint" in gates and not 0 <= alpha <= 1):
        return _met(df, by, gates, alpha, whole)
    return _Search(df, by, gates, alpha, rows, leaf).spread(whole) or _met(df, by, gates, alpha, whole)


def _met(df: DataFrame, by: list[str], gates: list[str], alpha: float, whole: bool) -> Spread:
    df = df.persist()
    every = pair_stats(df, [], gates, alpha).select(*STATS) if whole else None
    return Spread(pair_stats(df, by, gates, alpha).select(*by, *STATS), every, vector_sums(df, by))


# ---- inside tasks ---------------------------------------------------------------------------------


@dataclass
class _View:
    """How vectors of one gate become coordinates, and coordinates cells: a tree of cuts, as a heap."""

    basis: np.ndarray
    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    def coords(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coordinates and rest as floats, squared lengths, cells)."""
        p, size = m @ self.basis, (m * m).sum(1)
        # the square root of a rounded zero is far from zero
        rest = np.sqrt(np.maximum(size - (p * p).sum(1), 0)) + 1e-7 * np.sqrt(size)
        at = np.zeros(len(m), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(m)), self.dims[at]] >= self.cuts[at])
        return np.c_[p, rest].astype(np.float32), size, at - ((1 << self.depth) - 1)


def _view(m: np.ndarray) -> _View:
    m = m[np.isfinite(m).all(1)]
    basis = np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :COORDS]
    p, depth = m @ basis, max(0, int(math.log2(max(len(m) / 8, 1))))
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)

    def split(at: int, x: np.ndarray) -> None:
        if at >= len(dims):
            return
        d = int(x[:, :SPLIT].var(0).argmax())
        x = x[x[:, d].argsort(kind="stable")]
        dims[at], cuts[at] = d, x[len(x) // 2, d]
        split(2 * at + 1, x[: len(x) // 2])
        split(2 * at + 2, x[len(x) // 2 :])

    split(0, p)
    return _View(basis, dims, cuts, depth)


def _vectors(b: pa.RecordBatch, spaces: list[str], gates: list[str], alpha: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Per gate the vectors whose products are the similarities, and which rows have them all; the others are zero."""
    held = {s: A.matrix(b.column(b.schema.get_field_index(s))) for s in spaces}
    part = {s: np.zeros((b.num_rows, 1)) if m is None else m for s, (m, _) in held.items()}
    if "joint" in gates:
        part["joint"] = np.c_[math.sqrt(alpha) * part["visual"], math.sqrt(1 - alpha) * part["semantic"]]
    return {g: part[g] for g in gates}, np.logical_and.reduce([has for _, has in held.values()])


def _leaves(n: int, leaf: int) -> np.ndarray:
    """Where the leaves of n rows begin, and their end: halves of halves."""
    sizes = [n]
    while max(sizes) > leaf:
        sizes = [x for s in sizes for x in (s // 2, s - s // 2)]
    return np.cumsum([0, *sizes])


def _dealt(c: np.ndarray, leaf: int) -> np.ndarray:
    """The order of rows in which the leaves of :func:`_leaves` have near coordinates."""
    parts = [np.arange(len(c))]
    while max(map(len, parts)) > leaf:
        halves = []
        for ix in parts:
            x = c[ix, :SPLIT]
            o = np.argpartition(x[:, x.var(0).argmax()], len(ix) // 2) if len(ix) > 1 else np.arange(len(ix))
            halves += [ix[o[: len(ix) // 2]], ix[o[len(ix) // 2 :]]]
        parts = halves
    return np.concatenate(parts)


def _floats(col) -> np.ndarray:
    """The rows of floats of a binary column."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


def _once(same: np.ndarray, c: np.ndarray, group: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One row of each vector of a group, and whether it has more; ``twice`` are rows that are known to."""
    order = np.lexsort((same, group))
    x, y = order[1:], order[:-1]
    again = np.r_[False, (group[x] == group[y]) & (same[x] == same[y])]
    again[again] = (c[order[again]] == c[order[np.flatnonzero(again) - 1]]).all(1)
    more = np.r_[again[1:], False]
    if twice is not None:
        more = more | twice[order]
    number = np.cumsum(~again) - 1
    return order[~again], np.bincount(number, more, number[-1] + 1 if len(number) else 0) > 0


def _apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Squared distance between boxes: of every row of the first two with every row of the others."""
    out = np.zeros((len(lo), len(lo2)), lo.dtype)
    for d in range(lo.shape[1]):  # the first of the others' coordinates
        gap = np.maximum(lo[:, d, None] - hi2[None, :, d], lo2[None, :, d] - hi[:, d, None])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def _turned(lo: np.ndarray, hi: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of vectors, or with sign -1 of their opposites: the last entry is a length and stays."""
    if sign > 0:
        return lo, hi
    a, b = -hi, -lo
    a[:, -1], b[:, -1] = lo[:, -1], hi[:, -1]
    return a, b


class _Files:
    """Rows of the written files, read a few at a time."""

    def __init__(self, folder: str, names: list[str], gate: str, alpha: float):
        self.fs, self.at = pa.fs.FileSystem.from_uri(folder)
        self.names, self.spaces, self.alpha = names, SPACES[gate], alpha
        self.readers: OrderedDict = OrderedDict()
        self.held: OrderedDict = OrderedDict()

    def _part(self, file: int, part: int) -> dict[str, np.ndarray]:
        got = self.held.pop((file, part), None)
        if got is None:
            reader = self.readers.pop(file, None)
            if reader is None:
                reader = pa.ipc.open_file(self.fs.open_input_file(f"{self.at}/{self.names[file]}"))
            self.readers[file] = reader
            b = reader.get_batch(part)
            got = {s: A.matrix(b.column(b.schema.get_field_index(s)))[0] for s in self.spaces}
        self.held[file, part] = got
        for cache in (self.held, self.readers):
            if len(cache) > 64:
                cache.popitem(last=False)
        return got

    def rows(self, file: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
        parts = [(self._part(f, r // READ_ROWS), r % READ_ROWS) for f, r in zip(file.tolist(), row.tolist(), strict=True)]
        return {s: np.stack([p[s][r] for p, r in parts]) for s in self.spaces}

    def products(self, a: _Tile, i: np.ndarray, b: _Tile, j: np.ndarray) -> np.ndarray:
        x, y = self.rows(a.file[i], a.row[i]), self.rows(b.file[j], b.row[j])
        each = [np.einsum("ij,ij->i", x[s], y[s]) for s in self.spaces]
        return each[0] if len(each) == 1 else self.alpha * each[0] + (1 - self.alpha) * each[1]


class _Tile:
    """The rows of a cell as they are searched: coordinates in the order of the leaves, and where the vectors are."""

    def __init__(self, table: pa.Table, leaf: int):
        self.c = _floats(table.column("c"))
        self.file, self.row = A.column(table, "file"), A.column(table, "row")
        cuts = _leaves(len(self.c), leaf)
        self.start, self.end = cuts[:-1][np.diff(cuts) > 0], cuts[1:][np.diff(cuts) > 0]
        self.lo, self.hi = np.minimum.reduceat(self.c, self.start), np.maximum.reduceat(self.c, self.start)
        self.length = float(np.sqrt((self.c.astype(np.float64) ** 2).sum(1).max()))
        p, q = self.c[:, :-1], self.c[:, -1:]
        rest = np.sqrt((self.c[:, FEW:] ** 2).sum(1, keepdims=True)) if p.shape[1] > FEW else q
        self.few = np.c_[p[:, :FEW], rest]
        self.low = np.c_[p[:, :FEW], -rest]
        # from the middle of a leaf its rows are apart by a range in the first coordinate and a distance in the others
        sizes = (self.end - self.start)[:, None]
        self.middle = np.add.reduceat(self.c, self.start) / sizes.astype(np.float32)
        off = self.c - np.repeat(self.middle, sizes[:, 0], axis=0)
        first, others, radius = np.abs(off[:, 0]), np.sqrt((off[:, 1:-1] ** 2).sum(1)), np.sqrt((off**2).sum(1))
        self.off = np.c_[np.maximum.reduceat(first, self.start), np.maximum.reduceat(others, self.start)]
        self.radius = np.maximum.reduceat(radius, self.start)
        self.reach = np.c_[p, -np.abs(p[:, :1]), -np.sqrt((p[:, 1:] ** 2).sum(1)), -q]
        self.size = (self.c**2).sum(1)


def _tried(a: _Tile, b: _Tile, sign: int, same: bool, files: _Files) -> float:
    """A product that is near the least: a few rows go to their farthest row and back again."""
    turn = np.r_[np.full(a.c.shape[1] - 1, sign), 0].astype(np.float32)
    i = np.unique(np.linspace(0, len(a.c) - 1, 32).astype(np.int64))
    for _ in range(3):
        g = (a.c[i] * turn) @ b.c.T
        if same:
            g[np.arange(len(i)), i] = np.inf
        j = g.argmin(1)
        g = (b.c[j] * turn) @ a.c.T
        if same:
            g[np.arange(len(j)), j] = np.inf
        i = g.argmin(1)
    keep = i != j if same else np.ones(len(i), bool)
    return float((sign * files.products(a, i[keep], b, j[keep])).min()) if keep.any() else math.inf


def _least(a: _Tile, b: _Tile, sign: int, same: bool, best: float, floor: float, files: _Files) -> float:
    """The least of ``best`` and of sign times the products of rows of ``a`` with rows of ``b``.

    No product is below ``floor``.  The opposites of b's rows stand for a search of the greatest.
    """
    if best == math.inf:
        best = _tried(a, b, sign, same, files)
    if best <= floor * (1 - 1e-12) <= 0:
        return best
    slack = SLACK * a.length * b.length
    turn = np.r_[np.full(b.c.shape[1] - 1, sign), 1].astype(np.float32)
    few = b.few * np.r_[turn[: b.few.shape[1] - 1], np.float32(1)]
    sizes, square = a.end - a.start, a.length**2 + b.length**2
    if sign > 0:
        leaves, rows, near = np.c_[(b.middle * turn)[:, :-1], b.off, b.hi[:, -1]], a.reach, None
    else:
        # |x - y|^2 = |x|^2 + |y|^2 - 2 x.y: rows and leaves that are far from a leaf
        leaves = np.c_[-2 * b.middle, (b.middle**2).sum(1), np.ones(len(b.middle), np.float32)]
        rows = np.c_[a.c, np.ones(len(a.c), np.float32), a.size]
        near = _apart(b.lo, b.hi, a.lo, a.hi)
    wide = int((b.end - b.start).max())
    bound, picked = np.empty((STRIP_LEAVES, len(a.c)), np.float32), np.empty((STRIP_ROWS, few.shape[1]), np.float32)
    made = np.empty(STRIP_ROWS * wide, np.float32)
    for first in range(0, len(leaves), STRIP_LEAVES):
        strip = leaves[first : first + STRIP_LEAVES]
        np.matmul(strip, rows.T, out=bound[: len(strip)])
        for x in range(first, first + len(strip)):
            limit = best + slack
            if near is None:
                may = bound[x - first] < limit
            else:
                reach = math.sqrt(max(2 * limit + square, 0.0))
                may = bound[x - first] < (b.radius[x] + reach) ** 2
                may &= np.repeat(near[x] < reach**2, sizes)
            if same:  # each pair once: as a row before the leaf's
                may[b.end[x] :] = False
            all_rows, y = np.flatnonzero(may), few[b.start[x] : b.end[x]].T
            for start in range(0, len(all_rows), STRIP_ROWS):
                at = all_rows[start : start + STRIP_ROWS]
                g = made[: len(at) * y.shape[1]].reshape(len(at), -1)
                np.matmul(np.take(a.low, at, axis=0, out=picked[: len(at)], mode="clip"), y, out=g)
                if same and at[-1] >= b.start[x]:
                    own = np.searchsorted(at, b.start[x])
                    g[own:][at[own:, None] >= np.arange(b.start[x], b.end[x])] = np.inf
                if g.min() < best + slack:
                    best = _checked(a, b, at, b.start[x], g, turn, best, slack, files)
    return best


def _checked(a: _Tile, b: _Tile, at: np.ndarray, start: int, g: np.ndarray, turn: np.ndarray, best: float, slack: float, files: _Files) -> float:
    """``best``, or less if a pair that ``g`` (rows ``at`` of a, rows from ``start`` on of b) does not rule out has less."""
    r, c = np.divmod(np.flatnonzero(g.ravel() < best + slack), g.shape[1])
    r, c = at[r], c + start
    y = b.c[c] * turn
    y[:, -1] *= -1
    value = np.einsum("ij,ij->i", a.c[r], y)
    order = np.flatnonzero(value < best + slack)
    order = order[value[order].argsort()]
    for k in range(0, len(order), CHECKED):
        some = order[k : k + CHECKED]
        if value[some[0]] >= best + slack:
            break
        best = min(best, float((turn[0] * files.products(a, r[some], b, c[some])).min()))
    return best


# ---- the search -----------------------------------------------------------------------------------


class _Search:
    def __init__(self, df: DataFrame, by: list[str], gates: list[str], alpha: float, rows: int, leaf: int):
        self.by, self.gates, self.alpha, self.rows, self.leaf = by, gates, alpha, rows, leaf
        self.spark, self.spaces = df.sparkSession, sorted({s for g in gates for s in SPACES[g]}, reverse=True)
        self.df = df.select(*by, *self.spaces)
        self.folder = fresh_path(self.spark, "spread")

    def views(self, names: list[str]) -> dict[str, _View]:
        """From batches that lie apart in files that lie apart."""
        fs, at = pa.fs.FileSystem.from_uri(self.folder)
        some = names[:: math.ceil(len(names) * READ_ROWS / SAMPLE_ROWS)]
        each = max(1, SAMPLE_ROWS // (READ_ROWS * len(some)))
        parts: dict[str, list] = {g: [] for g in self.gates}
        for n in some:
            with fs.open_input_file(f"{at}/{n}") as f:
                reader = pa.ipc.open_file(f)
                for k in np.unique(np.linspace(0, reader.num_record_batches - 1, each).astype(int)).tolist():
                    m, _ = _vectors(reader.get_batch(k), self.spaces, self.gates, self.alpha)
                    for g in self.gates:
                        parts[g].append(m[g])
        return {g: _view(np.concatenate(v)) for g, v in parts.items()}

    def write(self) -> DataFrame:
        """Every row into a file; per file and group the number of rows and the vector sums."""
        by, gates, spaces, alpha, folder = self.by, self.gates, self.spaces, self.alpha, self.folder
        names = [f"{x}_{g}" for g in gates for x in ("sum", "square", "top")]
        schema = _ddl(self.df, by) + "file string, n bigint, unfit bigint, " + ", ".join(
            f"`{n}` {'array<double>' if n.startswith('sum') else 'double'}" for n in names
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = pa.fs.FileSystem.from_uri(folder)
            fs.create_dir(at, recursive=True)
            parts: list[pa.RecordBatch] = []
            sums: dict[tuple, list] = {}
            size, types = 0, []

            def flush() -> pa.RecordBatch:
                nonlocal size
                name = os.urandom(12).hex() + ".arrow"
                table = pa.Table.from_batches(parts).combine_chunks()
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                with fs.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_file(f, table.schema, options=options) as w:
                    w.write_table(table, max_chunksize=READ_ROWS)
                rows = list(sums.values())
                cols = [pa.array([k[i] for k in sums], types[i]) for i in range(len(by))]
                cols += [pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
                for k in range(len(names)):
                    cols.append(pa.array([r[2][k] if k % 3 else np.atleast_1d(r[2][k]).tolist() for r in rows], pa.float64() if k % 3 else pa.list_(pa.float64())))
                parts.clear()
                sums.clear()
                size = 0
                return pa.RecordBatch.from_arrays(cols, names=[*by, "file", "n", "unfit", *names])

            for whole in batches:
                types = [whole.schema.field(c).type for c in by]
                for start in range(0, whole.num_rows, 2048):
                    b = whole.slice(start, 2048)
                    m, fit = _vectors(b, spaces, gates, alpha)
                    squares = {g: (v * v).sum(1) for g, v in m.items()}
                    for x in squares.values():
                        fit = fit & ((x == 0) | ((x >= LENGTHS[0] ** 2) & (x <= LENGTHS[1] ** 2)))
                    for key, idx in _groups(b, by):
                        row = sums.setdefault(key, [0, 0, [0.0, 0.0, 0.0] * len(gates)])
                        row[0] += len(idx)
                        row[1] += int((~fit[idx]).sum())
                        idx = idx[fit[idx]]
                        for k, g in enumerate(gates if len(idx) else ()):
                            row[2][3 * k] = row[2][3 * k] + m[g][idx].sum(axis=0)
                            row[2][3 * k + 1] += float(squares[g][idx].sum())
                            row[2][3 * k + 2] = max(row[2][3 * k + 2], float(squares[g][idx].max()))
                    parts.append(pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in [*by, *spaces]], names=[*by, *spaces]))
                    size += sum(8 * m[g].size for g in gates)
                    if size >= HELD_BYTES:
                        yield flush()
            if parts:
                yield flush()

        return cut(self.df.mapInArrow(run, schema))

    def index(self, names: list[str], views: dict[str, _View]) -> DataFrame:
        """Coordinates of the rows of every file, in a file beside it; how many rows a group, gate and cell has there."""
        by, gates, spaces, alpha, folder = self.by, self.gates, self.spaces, self.alpha, self.folder
        held = self.spark.sparkContext.broadcast((names, views))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = pa.fs.FileSystem.from_uri(folder)
            names, views = held.value
            for n in (n for b in batches for n in b.column(0).to_pylist()):
                parts = []
                with fs.open_input_file(f"{at}/{names[n]}") as f:
                    t = pa.ipc.open_file(f).read_all().combine_chunks()
                for b in t.to_batches(max_chunksize=2048):
                    m, _ = _vectors(b, spaces, gates, alpha)
                    cols = [b.column(b.schema.get_field_index(c)) for c in by]
                    heads = list(by)
                    for g in gates:
                        c, square, cell = views[g].coords(m[g])
                        same = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in np.ascontiguousarray(m[g]))
                        kind = pa.binary(4 * c.shape[1])
                        cols += [pa.FixedSizeBinaryArray.from_buffers(kind, len(c), [None, pa.py_buffer(np.ascontiguousarray(c))])]
                        cols += [pa.array(cell.astype(np.int32)), pa.array(np.frombuffer(same, np.int64)), pa.array(square)]
                        heads += [f"{x}_{g}" for x in ("c", "cell", "same", "square")]
                    parts.append(pa.RecordBatch.from_arrays(cols, names=heads))
                table = pa.Table.from_batches(parts).combine_chunks()
                with fs.open_output_stream(f"{at}/{names[n]}.index") as f, pa.ipc.new_file(f, table.schema) as w:
                    w.write_table(table)
                b = table.to_batches()[0]
                for key, idx in _groups(b, by):
                    for k, g in enumerate(gates):
                        cells, number = np.unique(A.column(b, f"cell_{g}")[idx], return_counts=True)
                        cols = [pa.array([x] * len(cells), b.schema.field(c).type) for c, x in zip(by, key, strict=True)]
                        cols += [pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(number)]
                        yield pa.RecordBatch.from_arrays(cols, names=[*by, "gate", "cell", "rows"])

        return cut(self.numbers(names).mapInArrow(run, _ddl(self.df, by) + "gate int, cell int, rows bigint"))

    def numbers(self, names: list[str]) -> DataFrame:
        """The numbers of the files, a task each."""
        n = max(1, min(len(names), 4096))
        return self.spark.range(0, len(names), 1, n).select(F.col("id").cast("int").alias("file"))

    def spread(self, whole: bool) -> Spread | None:
        by, gates = self.by, self.gates
        files = self.write()
        tops = files.agg(F.sum("unfit").alias("unfit"), *[F.max(f"top_{g}").alias(f"top_{g}") for g in gates]).first()
        if tops["unfit"]:
            return None
        order = Window.orderBy(*by) if by else Window.orderBy(F.lit(0))
        sums = cut(self.sums(files, by).withColumn("_g", (F.row_number().over(order) - 1).cast("int")))  # one row a group
        found = self.extremes(files, sums, {g: tops[f"top_{g}"] or 0.0 for g in gates}, whole)
        groups = self.result(sums, found.filter("_g >= 0"), by)
        every = self.result(self.sums(sums.drop("_g"), []).withColumn("_g", F.lit(0)), found.withColumn("_g", F.lit(0)), []) if whole else None
        spaces = [F.col(f"sum_{g}").alias(g) for g in gates if g != "joint"]
        return Spread(groups, every, sums.select(*by, "n", *spaces))

    def sums(self, parts: DataFrame, by: list[str]) -> DataFrame:
        """Counts and vector sums of files, or of groups, added up by ``by``."""
        names = [f"{x}_{g}" for g in self.gates for x in ("sum", "square")]

        def merge(table: pa.Table) -> pa.Table:
            cols = [A.plain(table.column(c)).slice(0, 1) for c in by] + [pa.array([int(A.column(table, "n").sum())])]
            for n in names:
                if n.startswith("sum"):
                    cols.append(pa.array([A.matrix(table.column(n))[0].sum(axis=0).tolist()], pa.list_(pa.float64())))
                else:
                    cols.append(pa.array([float(A.column(table, n).sum())]))
            return pa.table(cols, names=[*by, "n", *names])

        schema = _ddl(parts, by) + "n bigint, " + ", ".join(f"`{n}` {'array<double>' if n.startswith('sum') else 'double'}" for n in names)
        keyed = parts.select(*by, "n", *names)
        grouped = keyed.groupBy(*by) if by else keyed.withColumn("_all", F.lit(0)).groupBy("_all")
        return grouped.applyInArrow(merge, schema)

    def result(self, sums: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
        ends = found.groupBy("_g", "gate").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        dot = lambda c: F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
        each = [
            F.struct(F.lit(g).alias("gate"), ((dot(f"sum_{g}") - F.col(f"square_{g}")) / 2).alias("s")) for g in self.gates
        ]
        long = sums.select("_g", *by, "n", F.explode(F.array(*each)).alias("e")).select("_g", *by, "n", "e.*")
        pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
        full = long.join(ends, ["_g", "gate"], "left").withColumn("pairs", pairs)
        mean = F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs"))
        return full.select(
            *by, "gate", F.col("n").alias("count"), "pairs", mean.alias("mean_similarity"),
            F.col("low").alias("min_similarity"), F.col("high").alias("max_similarity"),
        )

    def tiles(self, sums: DataFrame, names: list[str], views: dict[str, _View]) -> DataFrame:
        """A file of coordinates per group, gate and cell: its rows once each, with the ranges of their coordinates.

        Equal vectors of a cell are one row; what such a pair has is its squared length (``low`` and ``high``).
        """
        by, gates, folder, leaf, most = self.by, self.gates, self.folder, self.leaf, self.rows
        held_names = self.spark.sparkContext.broadcast(names)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = pa.fs.FileSystem.from_uri(folder)
            for n in (n for b in batches for n in b.column(0).to_pylist()):
                with fs.open_input_file(f"{at}/{held_names.value[n]}.index") as f:
                    t = pa.ipc.open_file(f).read_all().combine_chunks()
                group = np.zeros(t.num_rows, np.int64)
                for k, (_, idx) in enumerate(_groups(t.to_batches()[0], by)):
                    group[idx] = k
                for k, g in enumerate(gates):
                    row, twice = _once(A.column(t, f"same_{g}"), _floats(t.column(f"c_{g}")), group)
                    for start in range(0, len(row), 8192):
                        some = row[start : start + 8192]
                        s = t.take(pa.array(some))
                        cols = [A.plain(s.column(c)) for c in by] + [pa.array(np.full(len(some), k, np.int32)), A.plain(s.column(f"cell_{g}"))]
                        cols += [pa.array(np.full(len(some), n, np.int32)), pa.array(some.astype(np.int32)), pa.array(twice[start : start + 8192])]
                        cols += [A.plain(s.column(f"{x}_{g}")) for x in ("same", "square")] + [A.plain(s.column(f"c_{g}")).cast(pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=[*by, "gate", "cell", "file", "row", "twice", "same", "square", "c"])

        # the cells of a group are as fine as its rows need
        fine = F.greatest(F.ceil(F.log2(F.col("n") / most)), F.lit(0)).cast("int")
        keys = cut(sums.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_g", fine.alias("_fine")))
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        up = F.greatest(F.get(F.array(*[F.lit(views[g].depth) for g in gates]), F.col("gate")) - F.col("_fine"), F.lit(0))

        def celled(df: DataFrame) -> DataFrame:
            df = df.join(F.broadcast(keys), on).withColumn("cell", F.floor(F.col("cell") / F.pow(F.lit(2.0), up)).cast("int"))
            return df.drop(*[f"_b_{c}" for c in by], "_fine", *by)

        counts = celled(self.index(names, views)).groupBy("_g", "gate", "cell").agg(F.ceil(F.sum("rows") / F.lit(most)).cast("int").alias("_parts"))
        head = _ddl(self.df, by) + "gate int, cell int, file int, row int, twice boolean, same bigint, square double, c binary"
        laid = celled(self.numbers(names).mapInArrow(read, head)).join(F.broadcast(cut(counts)), ["_g", "gate", "cell"])
        laid = laid.withColumn("_part", F.pmod(F.xxhash64("same"), F.col("_parts")).cast("int")).drop("_parts")

        def write(table: pa.Table) -> pa.Table:
            c = _floats(table.column("c"))
            first, twice = _once(A.column(table, "same"), c, np.zeros(len(c), np.int64), A.column(table, "twice"))
            twice = A.column(table, "square")[first[twice]]
            order = first[_dealt(c[first], leaf)]
            kept = table.select(["c", "file", "row"]).take(pa.array(order))
            fs, at = pa.fs.FileSystem.from_uri(folder)
            name = os.urandom(12).hex() + ".cell"
            with fs.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_file(f, kept.schema) as w:
                w.write_table(kept)
            one = lambda x, t: pa.array([x], t)
            low, high = (float(twice.min()), float(twice.max())) if len(twice) else (None, None)
            floats = pa.list_(pa.float64())
            # gates of fewer coordinates share the batches of the others
            full = lambda x: [*x[:-1].tolist(), *[0.0] * (COORDS + 1 - len(x)), float(x[-1])]
            return pa.table({
                "_g": one(table.column("_g")[0].as_py(), pa.int32()), "gate": one(table.column("gate")[0].as_py(), pa.int32()), "name": one(name, pa.string()),
                "n": one(len(order), pa.int64()), "lo": one(full(c.min(0)), floats), "hi": one(full(c.max(0)), floats),
                "low": one(low, pa.float64()), "high": one(high, pa.float64()),
            })

        keys = ["_g", "gate", "cell", "_part"]
        schema = "_g int, gate int, name string, n bigint, lo array<double>, hi array<double>, low double, high double"
        return cut(laid.repartition(width(self.spark), *keys).groupBy(*keys).applyInArrow(write, schema))

    def extremes(self, files: DataFrame, sums: DataFrame, tops: dict[str, float], whole: bool) -> DataFrame:
        """(_g, gate, low, high): extremes found, several rows a group; with ``whole`` those between groups are of _g -1."""
        gates = self.gates
        names = sorted(r["file"] for r in files.select("file").distinct().collect())
        if not names:
            return self.spark.createDataFrame([], "_g int, gate string, low double, high double")
        tiles = self.tiles(sums, names, self.views(names))
        other = tiles.select(F.col("_g").alias("_h"), F.col("gate").alias("_gate"), F.col("name").alias("that"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        meet = (F.col("gate") == F.col("_gate")) & (F.col("name") <= F.col("that"))
        if not whole:
            meet = meet & (F.col("_g") == F.col("_h"))
        pairs = tiles.drop("low", "high").join(other, meet)
        pairs = pairs.withColumn("_g", F.when(F.col("_g") == F.col("_h"), F.col("_g")).otherwise(-1)).select("_g", "gate", "name", "that", "lo", "hi", "lo2", "hi2")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lo, hi, lo2, hi2 = (A.matrix(b.column(k))[0] for k in (4, 5, 6, 7))
                cols = list(b.columns[:4])
                if lo is None:
                    continue
                size, size2 = ((np.maximum(np.abs(x), np.abs(y)) ** 2) for x, y in ((lo, hi), (lo2, hi2)))
                most = np.sqrt(size.sum(1) * size2.sum(1))
                for sign in (1, -1):
                    x, y = _turned(lo2, hi2, sign)
                    corners = [lo * x, lo * y, hi * x, hi * y]
                    least = np.minimum.reduce([k[:, :-1] for k in corners]).sum(1) - hi[:, -1] * y[:, -1]
                    cols.append(pa.array(sign * (least - SLACK * most)))
                yield pa.RecordBatch.from_arrays(cols, names=["_g", "gate", "name", "that", "least", "most"])

        pairs = cut(pairs.mapInArrow(bounds, "_g int, gate int, name string, that string, least double, most double"))
        rank = lambda c: F.row_number().over(Window.partitionBy("_g", "gate").orderBy(c, "name", "that"))
        ranked = pairs.withColumn("_first", (rank(F.asc("least")) <= FIRST_PAIRS) | (rank(F.desc("most")) <= FIRST_PAIRS))
        equal = tiles.filter("low is not null").select("_g", "gate", "low", "high")
        known = equal.groupBy("_g", "gate").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        first = ranked.filter("_first").drop("_first").join(F.broadcast(known), ["_g", "gate"], "left")
        one = cut(self.search(first, names, tops))
        best = one.unionByName(equal)
        if whole:  # what is known within groups holds for all rows
            best = best.unionByName(best.withColumn("_g", F.lit(-1)))
        best = cut(best.groupBy("_g", "gate").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        rest = ranked.filter(~F.col("_first")).drop("_first").join(F.broadcast(best), ["_g", "gate"], "left")
        rest = rest.filter("low is null or high is null or least < low or most > high")
        two = cut(self.search(rest, names, tops))
        label = F.get(F.array(*[F.lit(g) for g in gates]), F.col("gate"))
        return one.unionByName(equal).unionByName(two).withColumn("gate", label)

    def search(self, pairs: DataFrame, names: list[str], tops: dict[str, float]) -> DataFrame:
        """(_g, gate, low, high) of pairs of cells; ``low`` and ``high`` of ``pairs`` are known ones, to be beaten."""
        gates, folder, alpha, leaf = self.gates, self.folder, self.alpha, self.leaf
        held_names = self.spark.sparkContext.broadcast(names)
        pairs = pairs.select("_g", "gate", "name", "that", "low", "high", "least", "most")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = [_Files(folder, held_names.value, g, alpha) for g in gates]
            fs, at = pa.fs.FileSystem.from_uri(folder)
            tiles: OrderedDict = OrderedDict()
            ends: dict[tuple, list[float]] = {}

            def tile(name: str) -> _Tile:
                got = tiles.pop(name, None)
                if got is None:
                    with fs.open_input_file(f"{at}/{name}") as f:
                        got = _Tile(pa.ipc.open_file(f).read_all(), leaf)
                tiles[name] = got
                if len(tiles) > 3:
                    tiles.popitem(last=False)
                return got

            for batch in batches:
                for r in batch.to_pylist():
                    end = ends.setdefault((r["_g"], r["gate"]), [math.inf, math.inf])
                    for k, (c, sign) in enumerate((("low", 1), ("high", -1))):
                        if r[c] is not None:
                            end[k] = min(end[k], sign * r[c])
                    a, b, same = tile(r["name"]), tile(r["that"]), r["name"] == r["that"]
                    if same and len(a.c) == 1:
                        continue
                    for k, sign in enumerate((1, -1)):
                        if sign * r[("least", "most")[k]] < end[k]:
                            end[k] = _least(a, b, sign, same, end[k], -tops[gates[r["gate"]]], files[r["gate"]])
            keys = list(ends)
            none = lambda x: None if math.isinf(x) else x
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([none(ends[k][0]) for k in keys], pa.float64()), pa.array([none(-ends[k][1]) for k in keys], pa.float64()),
            ], names=["_g", "gate", "low", "high"])

        n = max(1, min(pairs.count(), 16 * width(self.spark)))
        return pairs.repartitionByRange(n, "name", "that").mapInArrow(run, "_g int, gate int, low double, high double")
