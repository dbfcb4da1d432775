"""Pairwise work in bounded tiles.

Rows of a group are hashed into tiles of a bounded number of rows, and every unordered pair of tiles
becomes one shuffle group.  A kernel sees two tiles at a time and returns aggregates (extremes, counts,
best partners), so no task holds a whole group and no plan holds all pairs.  A hot group just has more
tile pairs, which hash to different partitions.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arrow as A
from ..session import cut, fresh_path, grouped, width

TILE_ROWS = 4096  # 4096 rows x 1024 doubles = 32 MB per side
TILE_BYTES = 32 << 20  # vectors of one side; tiles grow up to it where there would be many of them
MANY_TILES = 24  # a row goes into as many tile pairs as its group has tiles
STRIP_ROWS = 512  # rows of one similarity strip inside a kernel, at most
STRIP_DOUBLES = 1 << 19  # similarities of one strip (4 MB), whatever the tiles' size
BROADCAST_BYTES = 64 << 20  # a side is shipped whole only when it is measured to be below this


def peak_rows(df: DataFrame, by: list[str]) -> int:
    """Size of the largest group: one small job with map-side counts."""
    if not by:
        return df.count()
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fitted(df: DataFrame, rows: int, peak: int) -> int:
    """Rows of a tile: ``rows``, or more where a group of ``peak`` rows would have more than ``MANY_TILES`` tiles.

    Each row is shuffled once per tile of its group, so small tiles make the shuffle grow with the square of the rows.
    Larger ones keep it in proportion, until a tile's vectors reach ``TILE_BYTES``.
    """
    want = math.ceil(peak / MANY_TILES)
    spaces = [s for s in ("visual", "semantic", "vector") if s in df.columns]
    if want <= rows or not spaces:
        return rows
    sizes = df.agg(*[F.max(F.size(s)) for s in spaces]).first()
    return max(rows, min(want, TILE_BYTES // (8 * max(sum(max(int(x or 0), 0) for x in sizes), 1))))


def self_tiles(df: DataFrame, by: list[str], key: str, rows: int = TILE_ROWS, peak: int | None = None) -> DataFrame:
    """Each row once per tile pair it takes part in, with ``_lo``, ``_hi`` and the ``_side`` it is on."""
    peak = peak_rows(df, by) if peak is None else peak
    if peak <= rows:
        return df.withColumns({"_lo": F.lit(0), "_hi": F.lit(0), "_side": F.lit(0)})
    rows = fitted(df, rows, peak)
    if by:
        sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_tiles"))
        df = df.join(sizes, by)
    else:
        df = df.withColumn("_tiles", F.lit(math.ceil(peak / rows)))
    df = df.withColumn("_tile", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return df.withColumns(
        {
            "_lo": F.least("_tile", "_other"),
            "_hi": F.greatest("_tile", "_other"),
            "_side": F.when(F.col("_tile") <= F.col("_other"), 0).otherwise(1),
        }
    ).drop("_tile", "_other", "_tiles")


def cross_tiles(left: DataFrame, right: DataFrame, key: str, rows: int = TILE_ROWS) -> DataFrame:
    """Rows of two tables of one schema, laid out so that each pair of tiles meets in one group."""
    ln, rn = left.count(), right.count()
    lt = max(1, math.ceil(ln / fitted(left, rows, ln)))
    rt = max(1, math.ceil(rn / fitted(right, rows, rn)))

    def lay(df: DataFrame, own: str, own_n: int, other: str, other_n: int, side: int) -> DataFrame:
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))),
                "_side": F.lit(side),
            }
        )

    return lay(left, "_lo", lt, "_hi", rt, 0).unionByName(lay(right, "_hi", rt, "_lo", lt, 1))


def per_tile(tiled: DataFrame, by: list[str], kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return grouped(tiled, [*by, "_lo", "_hi"]).applyInArrow(kernel, schema)


def pairwise(df: DataFrame, by: list[str], key: str, kernel: Callable, schema: str, rows: int = TILE_ROWS) -> DataFrame:
    """``kernel`` on every pair of tiles of each group, as :func:`per_tile` on :func:`self_tiles` runs it.

    Groups of several tiles are not laid out once per pair: each tile is written to the shared folder once, as a file of
    its own, and the tasks of its pairs read it there.  So what is shuffled and written is the rows, whatever the
    number of tiles.  A file of a task that is run again has a new name, and only the listed ones are read.
    """
    peak = peak_rows(df, by)
    if peak <= rows:
        return per_tile(self_tiles(df, by, key, rows, peak), by, kernel, schema)
    spark, names, fit = df.sparkSession, df.columns, fitted(df, rows, peak)
    few = None
    if by:
        sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(fit)).cast("int").alias("_tiles"))
        small = df.join(sizes.filter("_tiles = 1").drop("_tiles"), by, "left_semi")
        few = per_tile(small.withColumns({"_lo": F.lit(0), "_hi": F.lit(0), "_side": F.lit(0)}), by, kernel, schema)
        df = df.join(sizes.filter("_tiles > 1"), by)
    else:
        df = df.withColumn("_tiles", F.lit(math.ceil(peak / fit)))
    df = df.withColumn("_tile", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int")).select(*names, "_tile")
    folder = fresh_path(spark, "tiles")

    def write(table: pa.Table) -> pa.Table:
        fs, at = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = os.urandom(12).hex() + ".arrow"
        with fs.open_output_stream(f"{at}/{name}") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        return table.select([*by, "_tile"]).slice(0, 1).append_column("_file", pa.array([name]))

    head = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    files = cut(grouped(df, [*by, "_tile"]).applyInArrow(write, ", ".join([*head, "_tile int", "_file string"])))
    other = files.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_tile").alias("_hi"), F.col("_file").alias("_that"))
    same = F.col("_tile") <= F.col("_hi")
    for c in by:
        same = same & (F.col(c) == F.col(f"_b_{c}"))
    pairs = cut(files.join(other, same).select("_file", "_that"))
    result = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(folder)

        def read(name: str) -> pa.Table:
            with fs.open_input_file(f"{at}/{name}") as f:
                return pa.ipc.open_file(f).read_all()

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = kernel(Pair(read(x), None if x == y else read(y)))
                yield from got.select(result.names).cast(result).combine_chunks().to_batches()

    n = max(width(spark), min(pairs.count(), 4096))
    out = pairs.repartition(n).mapInArrow(run, schema)
    return out if few is None else few.unionByName(out)


@dataclass
class Pair:
    """Two tiles of a group, or one and None, as a kernel reads them: columns are those of the first."""

    first: pa.Table
    second: pa.Table | None

    @property
    def schema(self) -> pa.Schema:
        return self.first.schema

    def column(self, name: str) -> pa.ChunkedArray:
        return self.first.column(name)


# ---- inside tasks ---------------------------------------------------------------------------------


class Block:
    """The rows of one side of a tile pair, in the order of their ordinals."""

    def __init__(self, table: pa.Table, visual="visual", semantic="semantic", order="ordinal"):
        ords = A.column(table, order)
        idx = np.argsort(ords, kind="stable")
        table = table.take(pa.array(idx))
        self.table = table
        self.ordinal = ords[idx]
        self.visual, _ = A.matrix(table.column(visual))
        self.has_semantic = np.zeros(len(idx), bool)
        self.semantic = None
        if semantic in table.column_names:
            self.semantic, self.has_semantic = A.matrix(table.column(semantic))

    def __len__(self) -> int:
        return len(self.ordinal)


def split_sides(table: pa.Table | Pair, **kw) -> tuple[Block, Block, bool]:
    """The two blocks of a tile pair; a tile paired with itself gives the same block twice."""
    if not isinstance(table, pa.Table):
        a = Block(table.first, **kw)
        return (a, a, True) if table.second is None else (a, Block(table.second, **kw), False)
    side = A.column(table, "_side")
    if not (side == 1).any():
        b = Block(table, **kw)
        return b, b, True
    return Block(table.filter(pa.array(side == 0)), **kw), Block(table.filter(pa.array(side == 1)), **kw), False


def strips(a: Block, b: Block, gates: list[str], alpha: float):
    """Yield (rows of a, {gate: similarities to b}) in strips, so no full tile product is held."""
    step = max(1, min(STRIP_ROWS, STRIP_DOUBLES // max(len(b), 1)))
    for s in range(0, len(a), step):
        rows = slice(s, min(s + step, len(a)))
        v = a.visual[rows] @ b.visual.T
        t = v
        if a.semantic is not None and b.semantic is not None and set(gates) != {"visual"}:
            t = a.semantic[rows] @ b.semantic.T
            both = a.has_semantic[rows, None] & b.has_semantic[None, :]
            if not both.all():
                t = np.where(both, t, v)
        out = {}
        for g in gates:
            if g == "visual":
                out[g] = v
            elif g == "semantic":
                out[g] = t
            elif g == "joint":
                # where the semantic space is missing t equals v, so the blend is v itself
                out[g] = v if t is v else alpha * v + (1.0 - alpha) * t
            elif g == "either_similar":
                out[g] = np.maximum(v, t)
            elif g == "either_distinct":
                out[g] = np.minimum(v, t)
            elif g == "gap":
                out[g] = v - t
            else:
                raise ValueError(f"unknown gate {g}")
        yield rows, out


def pair_mask(a: Block, b: Block, rows: slice, same: bool, differ: str | None = None) -> np.ndarray:
    """Which entries of a strip are pairs: each unordered pair once, optionally across ``differ`` only."""
    if same:
        n = rows.stop - rows.start
        mask = np.arange(len(b))[None, :] > (np.arange(n) + rows.start)[:, None]
    else:
        mask = np.ones((rows.stop - rows.start, len(b)), bool)
    if differ:
        mask &= A.column(a.table, differ)[rows][:, None] != A.column(b.table, differ)[None, :]
    return mask
