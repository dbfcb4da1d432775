import os
import threading

import pytest
from pyspark.sql import functions as F

from wordloom.functions import tables as FT
from wordloom.operators import poolsets as P
from wordloom.operators import sketches as SK
from wordloom.operators import templates as T
from wordloom.session import fresh_path
from wordloom.sources import seen as SE
from wordloom.sources import snapshots as SS


def numbers(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.md5(F.col("id").cast("string")).alias("hash"))


def test_readers_see_whole_versions_during_swaps(spark):
    path = fresh_path(spark, "table")
    SS.replace(spark, spark.range(1000).select("id", F.lit(0).alias("v")), path, keep=10)
    pinned, seen, stop = SS.read_version(spark, path), set(), threading.Event()

    def reader():
        while not stop.is_set():
            r = SS.read_version(spark, path).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
            seen.add((r.n, r.b - r.a))

    t = threading.Thread(target=reader)
    t.start()
    try:
        for _ in range(4):
            SS.replace(spark, SS.read_version(spark, path).withColumn("v", F.col("v") + 1), path, keep=10)
    finally:
        stop.set()
        t.join()
    assert seen == {(1000, 0)}
    assert pinned.agg(F.max("v")).first()[0] == 0 and SS.read_version(spark, path).agg(F.min("v")).first()[0] == 4
    assert SS.version(spark, path).number == 5


def test_colliding_writers_and_cleaning(spark):
    path = fresh_path(spark, "table")
    assert SS.version(spark, path) == SS.Version()
    with pytest.raises(ValueError):
        SS.read_version(spark, path)
    first = SS.replace(spark, spark.range(3), path)
    SS.replace(spark, spark.range(4), path)
    with pytest.raises(SS.Conflict):
        SS.commit(spark, path, ["part-x"], first)
    assert SS.read_version(spark, path).count() == 4
    SS.replace(spark, SS.read_version(spark, path).filter("id > 0"), path)
    assert SS.read_version(spark, path).count() == 3
    where = path.removeprefix("file:")
    assert len([x for x in os.listdir(where) if x.startswith("part-")]) == 2
    assert not [x for x in os.listdir(f"{where}/_versions") if x.startswith("_new")]


def test_a_batch_opens_few_folders(spark):
    path = fresh_path(spark, "seen")
    assert SE.append_seen(numbers(spark, 0, 20_000), path, buckets=16).opened == 0
    SE.append_seen(numbers(spark, 20_000, 40_000), path, buckets=16)
    fresh = SE.append_seen(numbers(spark, 100_000, 101_000), path, buckets=16)
    assert fresh.stored.count() == 1000 and (fresh.opened, fresh.folders) <= (3, 32)
    # Five hashes that are there, each in a folder of its own at most, and 995 that are not.
    mixed = SE.append_seen(numbers(spark, 39_995, 40_990), path, buckets=16)
    assert mixed.stored.count() == 990 and mixed.opened <= 8 and mixed.folders == 48
    replay = SE.append_seen(numbers(spark, 0, 20_000), path, buckets=16)
    assert replay.stored.count() == 0 and replay.opened >= 16
    assert SE.read_seen(spark, path).count() == 41_990
    SE.merged(spark, path, buckets=16, keep=1)
    assert SE.append_seen(numbers(spark, 5, 50), path, buckets=16).stored.count() == 0
    rows = SE.read_seen(spark, path)
    assert rows.columns == ["id", "hash"] and rows.count() == rows.select("hash").distinct().count() == 41_990
    where = path.removeprefix("file:")
    assert len([x for x in os.listdir(f"{where}/rows") if x.startswith("_part")]) == len(os.listdir(f"{where}/filters")) == 1


def test_seen_of_odd_batches(spark):
    path = fresh_path(spark, "seen")
    none = spark.createDataFrame([], "id bigint, hash string")
    assert SE.append_seen(none, path).stored.count() == 0 and SS.version(spark, path).number == 0
    rows = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None), (5, "")], "id bigint, hash string")
    assert sorted(r.id for r in SE.append_seen(rows, path, buckets=4).stored.collect()) == [1, 3, 5]
    assert [r.id for r in SE.append_seen(rows, path, buckets=4).stored.collect()] == [3]
    assert SE.append_seen(none, path, buckets=4).stored.count() == 0
    with pytest.raises(ValueError):
        SE.append_seen(rows.withColumn("_bucket", F.lit(1)), path)


def test_sketched_overlap_within_its_bound(spark):
    pool = lambda name, lo, hi: spark.range(lo, hi).select(F.lit(name).alias("pool"), F.lit("c").alias("category"), F.col("id").alias("ordinal"), F.concat(F.lit("w"), "id").alias("word"))
    rows = pool("a", 0, 40_000).union(pool("b", 30_000, 90_000)).union(pool("c", 0, 500)).union(pool("d", 100, 300)).union(pool("c", 0, 10))
    exact = {(r.pool_a, r.pool_b): r for r in P.pool_overlap(rows).collect()}
    whole = SK.pool_sketches(rows)
    parts = SK.pool_sketches(rows.filter("ordinal % 2 = 0")).union(SK.pool_sketches(rows.filter("ordinal % 2 = 1")))
    for sketches in (whole, SK.merged_sketches(parts)):
        got = SK.overlap_sketched(sketches).collect()
        assert len(got) == len(exact) == 6
        for r in got:
            assert abs(r.shared - exact[r.pool_a, r.pool_b].shared) <= r.bound
        assert {(r.pool_a, r.pool_b): r.bound for r in got}["c", "d"] == 0 < {(r.pool_a, r.pool_b): r.bound for r in got}["a", "b"] < 5000


def test_table_functions(spark):
    FT.register(spark)
    t = spark.createDataFrame([("x", "{c} and {c:2:, }{d:3:}{e::-} {é}"), ("y", None), ("z", "none")], "id string, structure string")
    got = spark.sql("SELECT id, s.* FROM {t} t, LATERAL slot_parts(t.structure) s ORDER BY id, slot_no", t=t).collect()
    assert [tuple(r)[1:5] for r in got] == [(0, "c", 1, " "), (1, "c", 2, ", "), (2, "d", 3, ""), (3, "e", 1, ":-")]
    assert sorted(map(tuple, got)) == sorted(map(tuple, T.parse_slots(t).collect()))
    got = spark.sql("SELECT * FROM unrank(123L, array(5L, 0L, 7L, 11L))").collect()
    assert [tuple(r) for r in got] == [(0, 5, 3), (1, 0, None), (2, 7, 3), (3, 11, 3)]
    assert spark.sql("SELECT * FROM unrank(CAST(NULL AS BIGINT), array(5L))").count() == 0
