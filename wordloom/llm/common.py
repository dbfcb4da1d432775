"""What the operators of this subpackage share: bounded batches, binary files in the shared folder, classes of ids."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import cut, fresh_path

T = TypeVar("T")
#: Bytes of text that a Python task works on at once; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Links of a part of a graph, as a power of two.
PART_BITS = 18


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as ``id`` and the text (null: empty) as ``text``; other columns, whatever their names, stay behind."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def once(name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once in each process and kept under ``name``.

    Kernels travel by value, each task with a copy of its own globals, and caches of decorated functions are pickled by
    name, which an executor without this package cannot resolve.  So the store is a module that every worker has.
    """
    store = sys.modules.setdefault("_wordloom_once", types.ModuleType("_wordloom_once")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES, also: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, and of ``also``, or of one row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = [pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (column, also) if c]
        ends = np.cumsum(sum(sizes))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach, as a URI or path that :func:`storage` takes."""
    path = fresh_path(spark, name)
    system, inner = storage(path)
    system.create_dir(inner, recursive=True)
    return path


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a URI (``file:``, ``hdfs:``, ``s3:`` ...) or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is not computed again when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", checkpoint_every: int = 1) -> DataFrame:
    """(node, component): the least node that links reach, for every node of ``edges``.

    Each round gives a node the least label among its own and its neighbours', then the label of that label.
    Rows of a null end are left out; loops and repeated links change nothing; no links give no rows.
    A round's rows are kept in as many parts as they need, not in as many as there are shuffle partitions: a small
    graph's rounds would leave thousands of files of a few rows.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    parts = (both.count() >> PART_BITS) + 1
    both = both.coalesce(parts)
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")).coalesce(parts))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("root"))
        after = cut(near.join(jump, "to", "left").select("node", "was", F.coalesce(F.least("root", "to"), "to").alias("component")).coalesce(parts))
        moved = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
