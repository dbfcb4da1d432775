"""Cases where the form for small inputs and the one for large inputs once differed."""

import numpy as np
import pytest
from helpers import unit_rows, vector_frame

from wordloom.functions.hashing import text_key
from wordloom.operators import centroids as C
from wordloom.operators import selection as S
from wordloom.operators.nearest import nearest
from wordloom.operators.ordered import dense_index, last_before, running_sum

FORMS = [{}, {"small": 2, "rows": 8}]


@pytest.fixture(scope="module")
def seeded(spark):
    a, b = unit_rows(30, 5, 1), unit_rows(30, 5, 2)
    df = vector_frame(spark, [("a", i, f"a{i}", v, v) for i, v in enumerate(a)] + [("b", 100 + i, f"b{i}", v, v) for i, v in enumerate(b)])
    return df, spark.createDataFrame([("a", i) for i in (3, 9, 11, 20, 27)], "category string, ordinal bigint")


@pytest.mark.parametrize("k, sizes", [(8, {"a": 8, "b": 8}), (3, {"a": 5, "b": 3})])
def test_seeds_of_one_group_only(seeded, k, sizes):
    df, seeds = seeded
    got = [sorted((r.category, r.rank, r.word) for r in S.diverse_words(df, k, seeds=seeds, **kw).collect()) for kw in FORMS]
    assert got[0] == got[1]
    assert {c: sum(x[0] == c for x in got[0]) for c in "ab"} == sizes


@pytest.mark.parametrize("gate", ["either_similar", "either_distinct", "visual", "semantic", "joint"])
def test_copies_of_vectors_unlike_themselves(spark, gate):
    u = unit_rows(6, 4, 3)
    short = np.array([0.5, 0, 0, 0])
    vectors = [*u, *[np.zeros(4)] * 4, *[short] * 5, *[u[0]] * 3]
    df = vector_frame(spark, [("t", i, f"w{i}", v, v) for i, v in enumerate(vectors)])
    got = [sorted((r.ordinal, r.kept) for r in S.mark_redundant(df, 0.85, gate, **kw).collect()) for kw in FORMS]
    assert got[0] == got[1] and sum(k for _, k in got[0]) >= 9


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_centroids_that_lack_a_category_and_repeated_rows(spark, limit):
    v = unit_rows(40, 4, 5)
    rows = [("xyz"[i % 3], i, f"w{i}", v[i], v[i]) for i in range(40)]
    df = vector_frame(spark, rows + rows[:3])
    cents = C.centroids(df, ["category"]).filter("category <> 'z'")
    got = C.closest_centroids(df, cents=cents, broadcast_bytes=limit, rows=8).collect()
    assert len(got) == 43
    assert all((r.own_joint is None) == (r.category == "z") and r.best_joint is not None for r in got)
    none = C.closest_centroids(df, cents=cents.filter("false"), broadcast_bytes=limit, rows=8)
    if limit == 0:
        assert none.count() == 43 and none.filter("best_joint is not null").count() == 0


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_queries_without_a_neighbour(spark, limit):
    base = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "n", None)], "ordinal bigint, word string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (5, None), (6, [0.0, 1.0])], "id bigint, vector array<double>")
    got = {r.id: (r.sim, r.near_word) for r in nearest(queries, base, exclude_self=True, broadcast_bytes=limit).collect()}
    assert got == {1: (None, None), 5: (None, None), 6: (0.0, "a")}
    only = queries.filter("id = 5")
    assert [tuple(r) for r in nearest(only, base, broadcast_bytes=limit).collect()] == [(5, None, None, None)]


def test_ordered_scans_on_any_type(spark):
    rows = [(i % 3, f"{i:04d}", None if i % 4 else i, i) for i in range(300)]
    for cast in ("string", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "k int, o string, v int, n int")
        df = df.withColumn("o", df.o if cast == "string" else df.n.cast("timestamp").cast("timestamp_ntz"))
        for scan in (
            lambda d, c: dense_index(d, ["k"], "o", chunk_rows=c),
            lambda d, c: running_sum(d, ["k"], "o", {"s": "n"}, chunk_rows=c),
            lambda d, c: last_before(d, ["k"], "o", ["v"], chunk_rows=c),
        ):
            assert sorted(map(str, scan(df, 10).collect())) == sorted(map(str, scan(df, 10_000).collect()))


def test_keys_lose_white_space_of_any_kind(spark):
    from pyspark.sql import functions as F

    words = [" Fog\t", "fog\n", " fog　", "\x1cfog\x1f", "two words "]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text_key(F.col("w"))).collect()]
    assert got == [w.lower().strip() for w in words]
