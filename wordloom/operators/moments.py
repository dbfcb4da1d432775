"""Pair statistics without pairs: vector sums and Gram matrices, summed map-side.

For unit vectors with S = sum(v) and G = sum(v v^T), the sum of the similarities over i<j is
(|S|^2 - sum|v|^2) / 2 and the sum of their squares is (|G|^2 - sum|v|^4) / 2.  Every partition emits one
partial per group, so a hot group costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A

MERGE_AT_ONCE = 256  # partial sums of one group that a task merges, by partitions that made them
HELD_DOUBLES = 16 << 20  # partial sums a Python worker holds before it flushes them (128 MB)


def _ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row indices per group of one Arrow batch."""
    if not by:
        yield (), np.arange(batch.num_rows)
        return
    codes = np.zeros(batch.num_rows, np.int64)
    for c in by:
        enc = A.plain(batch.column(batch.schema.get_field_index(c))).dictionary_encode(null_encoding="encode")
        codes = codes * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.nonzero(np.diff(codes[order]))[0] + 1
    for idx in np.split(order, cuts):
        if len(idx):
            yield tuple(batch.column(c)[int(idx[0])].as_py() for c in by), idx


def centroids(df: DataFrame, by: list[str]) -> DataFrame:
    """Unit mean vector per group in both spaces, with the word count and the first ordinal.

    A zero mean stays zero.  ``semantic`` is NULL for a group without semantic vectors.
    """
    return vector_sums(df, by, to_unit=True)


def vector_sums(df: DataFrame, by: list[str], to_unit: bool = False) -> DataFrame:
    """Sum of the vectors per group in both spaces, with the word count and the first ordinal.

    A task adds up its rows in numpy and emits one row per group.
    """
    df = df.select(*by, "ordinal", "visual", "semantic")
    head = _ddl(df, by)
    part_schema = head + "n bigint, first bigint, visual array<double>, semantic array<double>, ns bigint"

    def partial(batches):
        held: dict[tuple, list] = {}

        def flush():
            keys = list(held)
            rows = [held[k] for k in keys]
            held.clear()
            cols = [pa.array([k[i] for k in keys], types[i]) for i in range(len(by))]
            cols += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            cols += [pa.array([None if r[i] is None else r[i].tolist() for r in rows], pa.list_(pa.float64())) for i in (2, 3)]
            cols.append(pa.array([r[4] for r in rows], pa.int64()))
            return pa.RecordBatch.from_arrays(cols, names=[*by, "n", "first", "visual", "semantic", "ns"])

        types, size = None, 0
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            v, _ = A.matrix(batch.column(batch.schema.get_field_index("visual")))
            s, has = A.matrix(batch.column(batch.schema.get_field_index("semantic")))
            ords = A.column(batch, "ordinal")
            for key, idx in _groups(batch, by):
                row = held.get(key)
                if row is None:
                    row = held[key] = [0, int(ords[idx[0]]), 0.0, None, 0]
                    size += v.shape[1] * 2
                row[0] += len(idx)
                row[1] = min(row[1], int(ords[idx].min()))
                row[2] = row[2] + v[idx].sum(axis=0)
                if s is not None and has[idx].any():
                    row[3] = s[idx].sum(axis=0) + (0.0 if row[3] is None else row[3])
                    row[4] += int(has[idx].sum())
            if size > HELD_DOUBLES:
                yield flush()
                size = 0
        if held:
            yield flush()

    def merge(table: pa.Table, last: bool = True) -> pa.Table:
        def unit(name):
            m, ok = A.matrix(table.column(name))
            if m is None:
                return None
            total = m.sum(axis=0)
            n = np.linalg.norm(total) if to_unit and last else 0.0
            return (total / n if n > 0 else total).tolist()

        cols = [table.column(c).combine_chunks().slice(0, 1) for c in by]
        cols.append(pa.array([int(A.column(table, "n").sum())], pa.int64()))
        cols.append(pa.array([int(A.column(table, "first").min())], pa.int64()))
        cols += [pa.array([unit(c)], pa.list_(pa.float64())) for c in ("visual", "semantic")]
        return pa.table(cols, names=[*by, "n", "first", "visual", "semantic"])

    parts = df.mapInArrow(partial, part_schema).drop("ns")
    sums = head + "n bigint, first bigint, visual array<double>, semantic array<double>"
    parts = _in_steps(df, parts, by, lambda t: merge(t, False), sums)
    grouped = parts.groupBy(*by) if by else parts.withColumn("_all", F.lit(0)).groupBy("_all")
    return grouped.applyInArrow(lambda t: merge(t), sums)


def _in_steps(df: DataFrame, parts: DataFrame, by: list[str], merge, schema: str) -> DataFrame:
    """Partial sums, merged ``MERGE_AT_ONCE`` partitions at a time where ``df`` has more: no task then gets the
    partials of all partitions of a group."""
    if df.rdd.getNumPartitions() <= MERGE_AT_ONCE:
        return parts
    dealt = parts.withColumn("_step", F.expr(f"spark_partition_id() div {MERGE_AT_ONCE}"))
    return dealt.groupBy(*by, "_step").applyInArrow(lambda t: merge(t.drop_columns(["_step"])), schema)


def pair_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: number of pairs i<j and the sums of x, y, x^2, y^2, xy over them.

    x is the visual and y the semantic similarity.  The sums of different groups add up, so totals over
    groups need no second pass.  Costs O(n d^2) and emits no pairs.
    """
    df = df.select(*by, "visual", "semantic")
    head = _ddl(df, by)

    def partial(batches):
        held: dict[tuple, dict[str, np.ndarray]] = {}
        types, size = None, 0

        def flush():
            for key, kinds in held.items():
                for kind, m in kinds.items():
                    cols = [pa.array([key[i]] * len(m), types[i]) for i in range(len(by))]
                    cols += [pa.array([kind] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), A.lists(m)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*by, "kind", "i", "row"])
            held.clear()

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            v, _ = A.matrix(batch.column(batch.schema.get_field_index("visual")))
            s, has = A.matrix(batch.column(batch.schema.get_field_index("semantic")))
            s = v if s is None else np.where(has[:, None], s, 0.0)
            for key, idx in _groups(batch, by):
                a, b = v[idx], s[idx]
                qa, qb = (a * a).sum(axis=1), (b * b).sum(axis=1)
                new = {
                    "n": np.array([[len(idx), qa.sum(), qb.sum(), (qa * qa).sum(), (qb * qb).sum(), (qa * qb).sum()]]),
                    "v": a.sum(axis=0)[None], "s": b.sum(axis=0)[None],
                    "vv": a.T @ a, "ss": b.T @ b, "vs": a.T @ b,
                }
                old = held.get(key)
                if old is None:
                    held[key] = new
                    size += sum(m.size for m in new.values())
                else:
                    for k, m in new.items():
                        old[k] += m
            if size > HELD_DOUBLES:
                yield from flush()
                size = 0
        yield from flush()

    def add(table: pa.Table) -> pa.Table:
        m, _ = A.matrix(table.column("row"))
        cols = [table.column(c).combine_chunks().slice(0, 1) for c in [*by, "kind", "i"]]
        return pa.table([*cols, A.lists(m.sum(axis=0)[None])], names=[*by, "kind", "i", "row"])

    def merge(table: pa.Table) -> pa.Table:
        m, _ = A.matrix(table.column("row"))
        total = m.sum(axis=0)
        cols = [table.column(c).combine_chunks().slice(0, 1) for c in [*by, "kind"]]
        cols.append(pa.array([float((total * total).sum())], pa.float64()))
        is_n = table.column("kind")[0].as_py() == "n"
        cols.append(pa.array([total.tolist() if is_n else None], pa.list_(pa.float64())))
        return pa.table(cols, names=[*by, "kind", "sq", "scalars"])

    kinds = head + "kind string, i int, row array<double>"
    parts = _in_steps(df, df.mapInArrow(partial, kinds), [*by, "kind", "i"], add, kinds)
    rows = parts.groupBy(*by, "kind", "i").applyInArrow(merge, head + "kind string, sq double, scalars array<double>")
    g = rows.groupBy(*by).agg(
        F.max("scalars").alias("c"),
        *[F.sum(F.when(F.col("kind") == k, F.col("sq"))).alias(k) for k in ("v", "s", "vv", "ss", "vs")],
    )
    c = lambda i: F.element_at("c", i + 1)
    return g.select(
        *by,
        c(0).cast("bigint").alias("n"),
        F.expr("cast(cast(element_at(c, 1) AS decimal(38, 0)) * (cast(element_at(c, 1) AS decimal(38, 0)) - 1) / 2 AS bigint)").alias("pairs"),
        ((F.col("v") - c(1)) / 2).alias("x"),
        ((F.col("s") - c(2)) / 2).alias("y"),
        ((F.col("vv") - c(3)) / 2).alias("xx"),
        ((F.col("ss") - c(4)) / 2).alias("yy"),
        ((F.col("vs") - c(5)) / 2).alias("xy"),
    )


def mean_std(total, total_sq, n):
    mean = F.when(n > 0, total / n)
    return mean, F.sqrt(F.greatest(total_sq / n - mean * mean, F.lit(0.0)))


def correlation(n, x, y, xx, yy, xy):
    """Pearson r of the pair similarities, from their sums."""
    spread = F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0)))
    return F.when(spread > 0, (n * xy - x * y) / spread)
