"""Whitening of embeddings by QDWH spectral divide and conquer.

The covariance is exact: vectors become integers, a first pass gives their count and sums, a second adds up the products
of what is left after the nearest integer mean is taken off, and the remainder of the mean is put right in rational
numbers.  Tasks add up their own rows, so what is shuffled is one triangle of a matrix a task, whatever keys or copies
the rows hold.

Its eigenvectors come from polar decompositions (QDWH: dynamically weighted Halley steps by QR) of the shifted matrix:
the factor of ``A - s I`` is the sign of its eigenvalues, half of that plus the identity projects on the space of those
above the shift, and the matrix is split into the two invariant subspaces, each treated alike, until one dimension is
left or the rest is a multiple of the identity.  Only subspaces that hold wanted components are split further.  This is
work on one matrix of the vectors' dimension, which the number of rows doesn't change; it is broadcast for whitening.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to every integer, as the contract has it; it is taken off again before anything is multiplied.
SCALE, BASE = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues below this share of the largest are rounding of zero: such a direction cannot be scaled to one.
NOTHING = 1e-13
#: Largest distance from the mean, in integer units, whose square a double holds exactly.
REACH = 1 << 26


def usable(vec: Column) -> Column:
    """Vectors that are not null, not empty and hold finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad), F.lit(False))


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of every entry, as doubles that are whole numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(vectors), -1)


def _small(x: np.ndarray) -> np.ndarray:
    if x.size and np.abs(x).max() >= REACH:
        raise OverflowError(f"an entry lies {REACH} or more integer steps from its mean; exact sums do not fit 64 bits")
    return x


def sums(df: DataFrame, scale: int = SCALE) -> tuple[int, list[int]]:
    """Count and sums by dimension of the integers of column ``v``, without ``BASE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = integers(b.column(0), scale)
                if np.abs(x).max() >= 2.0**53:
                    raise OverflowError("an entry is too large for exact integers")
                # Halves of 26 bits: their sums over a batch are exact in doubles, so any entry below 2**53 is.
                high = np.floor(x / REACH)
                part = [int(h) * REACH + int(r) for h, r in zip(high.sum(0), (x - high * REACH).sum(0), strict=True)]
                total = part if total is None else [p + t for p, t in zip(part, total, strict=True)]
                n += b.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])], ["i", "n", "s"])

    parts = df.select("v").mapInArrow(run, "i int, n long, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def covariance(df: DataFrame, n: int, total: list[int], scale: int = SCALE) -> np.ndarray:
    """The covariance with divisor ``n``, each entry the double next to its exact value."""
    near = [round(Fraction(s, n)) for s in total]
    at, d = np.array(near, np.float64), len(total)
    left = [s - n * m for s, m in zip(total, near, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((d, d), np.int64)

        def out():
            i, j = np.triu_indices(d)
            return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[i, j])], ["i", "j", "s"])

        room, any_rows = 2.0**62, False
        for b in batches:
            if not b.num_rows:
                continue
            y = _small(integers(b.column(0), scale) - at)
            most = max(1.0, np.abs(y).max())
            step = max(1, int(2.0**53 // most**2))  # products of so many rows add up exactly in doubles
            if room < b.num_rows * most**2:
                yield out()
                held, room = np.zeros((d, d), np.int64), 2.0**62
            room -= b.num_rows * most**2
            for k in range(0, len(y), step):
                held += (y[k : k + step].T @ y[k : k + step]).astype(np.int64)
            any_rows = True
        if any_rows:
            yield out()

    rows = df.select("v").mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    v = np.zeros((d, d))
    for r in rows:
        v[r.i, r.j] = v[r.j, r.i] = float(Fraction(n * int(r.s) - left[r.i] * left[r.j], n * n))
    return v


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QDWH; for eigenvalues, their sign."""
    d = len(a)
    x = a / np.linalg.norm(a)
    least = max(np.linalg.svd(x, compute_uv=False)[-1] * 0.9, 1e-17) if d > 1 else 1.0
    for _ in range(40):
        dd = np.cbrt(4 * (1 - least**2) / least**4) if least < 1 else 0.0
        root = np.sqrt(1 + dd)
        p = root + 0.5 * np.sqrt(8 - 4 * dd + 8 * (2 - least**2) / (least**2 * root))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        z = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(d)]))[0]
        y = q / c * x + (p - q / c) / np.sqrt(c) * z[:d] @ z[d:].T
        y = (y + y.T) / 2
        least = min(1.0, least * (p + q * least**2) / (1 + c * least**2))
        moved = np.linalg.norm(y - x)
        x = y
        if moved < 1e-15 * d or abs(1 - least) < 1e-15 and moved < 1e-8:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift that leaves both some; None if no shift does."""
    d, size = len(a), np.linalg.norm(a)
    mean = np.trace(a) / d
    middle = np.median(np.diag(a))
    for shift in (middle, mean, (middle + mean) / 2, *(mean + f * size / np.sqrt(d) for f in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.01, -0.01))):
        u = polar(a - shift * np.eye(d))
        project = (u + np.eye(d)) / 2
        rank = round(float(np.trace(project)))
        if not 0 < rank < d or np.linalg.norm(project @ project - project) > 1e-8:
            continue
        # Subspace iteration from random columns: one step gives the range of a projector, the second cleans it up.
        q = np.linalg.qr(project @ np.random.default_rng(d).normal(size=(d, rank)))[0]
        whole = np.linalg.qr(np.hstack([project @ q, np.random.default_rng(d + 1).normal(size=(d, d - rank))]))[0]
        top, low = whole[:, :rank], whole[:, rank:]
        if np.linalg.norm(low.T @ a @ top) <= 1e-12 * size * np.sqrt(d):
            return top, low
    return None


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``wanted`` largest eigenvalues of a symmetric matrix, falling.

    Of equal eigenvalues any orthonormal basis of their space is right; one is chosen, the same in every run.
    """
    d, found = len(v), []
    scale = np.linalg.norm(v)
    todo = [np.eye(d)]  # bases of subspaces, the last with the largest eigenvalues
    while todo and len(found) < wanted:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        k = len(a)
        flat = np.linalg.norm(a - np.trace(a) / k * np.eye(k)) <= 4e-16 * scale * k
        halves = None if k == 1 or flat else _halves(a)
        if halves is None:
            values = np.diag(a)
            order = np.argsort(-values, kind="stable")
            found += [(values[i], basis[:, i]) for i in order]
        else:
            top, low = (np.linalg.qr(basis @ h)[0] for h in halves)
            todo += [low, top]
    found = sorted(found, key=lambda x: -x[0])[:wanted]
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    return np.array([e for e, _ in found]), np.stack([u for _, u in found], 1)


def _error(df: DataFrame, n: int, at: np.ndarray, weights: np.ndarray, scale: int) -> float:
    """The largest entry of the whitened rows' own covariance less the identity, from one more pass over them."""
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if b.num_rows:
                w = np.c_[(integers(b.column(0), scale) - at) @ weights, np.ones(b.num_rows)]
                total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    s = np.zeros((k + 1, k + 1))
    for r in df.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        s[r.i, r.j] = s[r.j, r.i] = r.s
    mean = s[:k, k] / n
    return float(np.abs(s[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(``id_col``, n, deviation, whitened, explained, identity_error): one row for each usable row of ``df``.

    ``whitened`` and ``explained`` are arrays by component, of falling variance.  A null vector, an empty one, and one
    with null or non-finite entries is left out, as are vectors of another length than the commonest (of equally common
    ones, the longest).  Null and repeated ids are rows like any other, and equal vectors get equal results.  Components
    without variance (fewer rows than dimensions, constant dimensions) cannot be scaled to one and are not returned, so
    that a table of copies of one vector, or of one row, gives empty arrays; an empty table gives no rows.  Only the id
    and the vector are read, so other columns may have any name.
    """
    rows = df.select(df[id_col].alias("i"), df[vec_col].cast("array<double>").alias("v")).where(usable(F.col("v")))
    key = df.schema[id_col].dataType.simpleString()
    schema = f"i {key}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    named = lambda out: out.withColumnRenamed("i", id_col)
    if common is None:
        return named(df.sparkSession.createDataFrame([], schema))
    rows = rows.where(F.size("v") == common.d)
    n, total = sums(rows, scale)
    v = covariance(rows, n, total, scale)
    values, vectors = components(v, wanted)
    real = values > NOTHING * max(values.max(initial=0.0), 0.0)
    values, vectors = values[real], vectors[:, real]
    explained = (values / np.trace(v)).tolist() if len(values) else []
    weights = vectors / np.sqrt(values)
    near = [round(Fraction(s, n)) for s in total]
    at, rest = np.array(near, np.float64), np.array([s - n * m for s, m in zip(total, near, strict=True)], np.float64)
    mean = at + rest / n
    error = _error(rows, n, mean, weights, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = integers(b.column(1), scale) - at
            if (np.abs(y).max() * n + n) ** 2 * y.shape[1] < 2.0**62:
                whole = (n * y.astype(np.int64) - rest.astype(np.int64)) ** 2
                deviation = pa.array(whole.sum(1))
            else:  # exact in Python's integers; a sum over 64 bits is an error of the column's type
                deviation = pa.array([sum((n * int(x) - int(r)) ** 2 for x, r in zip(row, rest, strict=True)) for row in y], pa.int64())
            w = (y - rest / n) @ weights
            k, m = w.shape[1], b.num_rows
            ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(m, n)), deviation, pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1))), pa.ListArray.from_arrays(ends, pa.array(np.tile(explained, m).astype(np.float64))), pa.array(np.full(m, error))],
                ["i", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return named(rows.mapInArrow(run, schema))
