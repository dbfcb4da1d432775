"""Prompt history in hash buckets with a Bloom filter each: a batch opens only the folders that may hold its hashes.

Every append is a part of a versioned table (:mod:`snapshots`): rows under ``rows/_part=<part>/_bucket=<n>`` and filters
under ``filters/<part>``.  A filter is made of bitmaps of 32768 bits; a hash falls into one of them and sets ``PROBES`` bits
there, so a look-up is one key join and a few bytes read.  Rows and filters of a part count from one rename on.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import snapshots as S
from .history import first_writes

BUCKETS, SEGMENT_BITS, BITS_A_HASH, PROBES = 64, 32768, 24, 8
FILTERS = "_bucket int, segments bigint, segment bigint, bits binary"


@dataclass(frozen=True)
class Appended:
    stored: DataFrame
    opened: int
    folders: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")


def _places() -> Column:
    """Bits of a hash: pieces of 15 bits of two further hashes."""
    pieces = [F.shiftrightunsigned(F.xxhash64("hash", F.lit(seed)), 15 * k).bitwiseAND(F.lit(SEGMENT_BITS - 1)) for seed in (2, 3) for k in range(PROBES // 2)]
    return F.array(*pieces)


def _segment() -> Column:
    return F.pmod(F.xxhash64("hash", F.lit(1)), F.col("segments"))


def _filters(hashes: DataFrame) -> DataFrame:
    """(_bucket, segments, segment, bits) of (hash, _bucket); the sizes joined have a row for each bucket."""
    sizes = hashes.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) * BITS_A_HASH / SEGMENT_BITS).alias("segments"))
    bits = hashes.join(F.broadcast(sizes), "_bucket").select("_bucket", "segments", _segment().alias("segment"), F.explode(_places()).alias("place"))
    return bits.groupBy("_bucket", "segments", "segment").agg(F.bitmap_construct_agg("place").alias("bits"))


def _store(rows: DataFrame, path: str, buckets: int) -> str:
    part = f"part-{os.urandom(8).hex()}"
    placed = rows.withColumn("_bucket", _bucket(buckets))
    # Hashes deal rows evenly, so a bucket is one task and one file.
    placed.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows/_part={part}")
    _filters(placed.select("hash", "_bucket")).coalesce(1).write.parquet(f"{path}/filters/{part}")
    return f"rows/_part={part}"


def _name(part: str) -> str:
    return part.split("=", 1)[1]


def _candidates(new: DataFrame, path: str, parts: list[str], buckets: int) -> DataFrame:
    """(part, _bucket, hash) of hashes that a folder's filter does not rule out."""
    spark = new.sparkSession
    stored = spark.read.schema(FILTERS).parquet(*[f"{path}/filters/{p}" for p in parts])
    stored = stored.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
    heads = stored.select("part", "_bucket", "segments").distinct()
    asked = new.select("hash", _bucket(buckets).alias("_bucket"), _places().alias("places"))
    asked = asked.join(heads, "_bucket").withColumn("segment", _segment()).drop("segments")
    byte = lambda p: F.conv(F.hex(F.substring("bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = lambda p: F.getbit(byte(p), F.pmod(p, F.lit(8)).cast("int")) == 1
    return asked.join(stored.drop("segments"), ["part", "_bucket", "segment"]).filter(F.forall("places", hit)).select("part", "_bucket", "hash")


def append_seen(prompts: DataFrame, path: str, order: str = "id", buckets: int = BUCKETS) -> Appended:
    """Insert-or-ignore on the hash, as :func:`history.append_new`: the first write of a batch unless history has it.

    ``buckets`` is the table's, the same for every append.  A null hash is new each time.  A hash is held against a
    filter of each part, so a table of many appends should be :func:`merged` now and then.  Two writers at once: one
    raises :class:`snapshots.Conflict` and stores nothing.
    """
    spark = prompts.sparkSession
    if {"_bucket", "_part"} & set(prompts.columns):
        raise ValueError("the columns _bucket and _part are the table's own")
    before = S.version(spark, path)
    new = cut(first_writes(prompts, order).select(*prompts.columns))
    opened = folders = 0
    if before.parts:
        names = [_name(p) for p in before.parts]
        found = cut(_candidates(new, path, names, buckets))
        # A row for each folder of the table at most.
        touched = [(r["part"], r["_bucket"]) for r in found.select("part", "_bucket").distinct().collect()]
        opened, folders = len(touched), len(names) * buckets
        if touched:
            old = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/_part={p}/_bucket={b}" for p, b in touched]).select("hash")
            hits = found.select("hash").distinct().join(old, "hash", "left_semi")
            new = cut(new.join(hits, "hash", "left_anti").select(*prompts.columns))
    if new.isEmpty():
        return Appended(new, opened, folders)
    S.commit(spark, path, [*before.parts, _store(new, path, buckets)], before)
    return Appended(new, opened, folders)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """All prompts of the newest version."""
    return _read(spark, path, S.version(spark, path))


def _read(spark: SparkSession, path: str, at: S.Version) -> DataFrame:
    return S.read_version(spark, path, at, base=f"{path}/rows").drop("_bucket", "_part")


def merged(spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = 2) -> S.Version:
    """All parts as one, with filters of its size; ``buckets`` may change here.  Readers go on meanwhile; an append at
    the same time and this collide, and one raises.  Parts that none of the last ``keep`` versions names are removed."""
    before = S.version(spark, path)
    if not before.parts:
        return before
    new = S.commit(spark, path, [_store(_read(spark, path, before), path, buckets)], before)
    S.clean(spark, path, keep, lambda part: [part, f"filters/{_name(part)}"])
    return new
