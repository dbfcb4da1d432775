import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import unit_rows, vector_frame
from wordloom.operators import selection as S
from wordloom.operators.cells import Balls, Cells, compared, similar_pairs
from wordloom.operators.pairs import top_pairs
from wordloom.operators.nearest import nearest, nearest_indexed


def clustered(n, centres=40, d=16, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    c = unit_rows(centres, d, seed)
    v = c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def base_frame(spark, v):
    return spark.createDataFrame([(i, f"w{i}", [float(x) for x in r]) for i, r in enumerate(v)], "ordinal long, word string, vector array<double>")


def gates(sv, ss, has):
    t = np.where(has[:, None] & has[None, :], ss, sv)
    return {"visual": sv, "semantic": t, "joint": 0.5 * sv + 0.5 * t, "either_similar": np.maximum(sv, t), "either_distinct": np.minimum(sv, t), "gap": sv - t}


def mixed(n, seed):
    """Unit, long, short and zero vectors, copies, and rows without a semantic vector."""
    rng = np.random.default_rng(seed)
    v, s = clustered(n, 12, 5, 0.1, seed) * rng.choice([0.3, 1, 4], n)[:, None], clustered(n, 9, 4, 0.2, seed + 1)
    v[3] = 0
    v[10:14] = v[9]
    s[10:14] = s[9]
    has = rng.random(n) > 0.2
    return v, s, has


@pytest.mark.parametrize("gate", ["visual", "semantic", "joint", "either_similar", "either_distinct", "gap"])
def test_bounds_hold_for_every_row_of_a_cell(spark, gate):
    v, s, has = mixed(150, 5)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], s[i] if has[i] else None) for i in range(150)])
    index = Cells(df, "ordinal", cells=11)
    cell = {r.ordinal: r._cell for r in index.assign(df).select("ordinal", "_cell").collect()}
    low, high = index.balls.bounds({"visual": (v, np.ones(150, bool)), "semantic": (np.where(has[:, None], s, 0.0), has)}, gate)
    sim = gates(v @ v.T, s @ s.T, has)[gate]
    of = np.array([cell[i] for i in range(150)])
    assert (low[:, of] <= sim).all() and (sim <= high[:, of]).all()
    assert isinstance(index.balls, Balls) and index.balls.used[of].all()


@pytest.mark.parametrize("gate,threshold", [("visual", 0.9), ("semantic", 0.8), ("joint", 0.5), ("either_similar", 0.95), ("either_distinct", 0.4), ("gap", 0.3)])
def test_similar_pairs_equal_all_pairs(spark, gate, threshold):
    v, s, has = mixed(200, 8)
    rows = [("ab"[i % 2], i, f"w{i}", v[i], s[i] if has[i] else None) for i in range(200)]
    sim = gates(v @ v.T, s @ s.T, has)[gate]
    want = {(("ab"[i % 2]), i, j) for i in range(200) for j in range(i + 1, 200) if i % 2 == j % 2 and sim[i, j] > threshold}
    df = vector_frame(spark, rows).repartition(5)
    got = similar_pairs(df, threshold, gate, rows=32, cells=9).collect()
    assert len(got) == len(want) and {(r.category, r.i, r.j) for r in got} == want
    assert all(abs(r.similarity - sim[r.i, r.j]) < 1e-12 for r in got)
    loose = {(i, j) for i in range(200) for j in range(i + 1, 200) if sim[i, j] > threshold}
    assert {(r.i, r.j) for r in similar_pairs(df, threshold, gate, by=[], rows=64).collect()} == loose


def test_pairs_of_an_empty_table_and_of_one_row(spark):
    assert similar_pairs(vector_frame(spark, []), 0.5).count() == 0
    assert similar_pairs(vector_frame(spark, [("a", 1, "x", [1.0, 0.0], None)]), 0.5).count() == 0


def test_compared_pairs_grow_less_than_the_square(spark):
    """Cells of a fixed number of rows: of clustered vectors ever fewer cells can reach the threshold."""
    seen = {}
    for n in (1000, 4000):
        v = clustered(n)
        df = vector_frame(spark, [("a", i, f"w{i}", v[i], None) for i in range(n)])
        index = Cells(df, "ordinal", rows=n // 50)
        seen[n] = compared(index.tiles(df, ["category"], "visual", 0.95), ["category"])
    for n, m in seen.items():
        assert m < 0.3 * n * n / 2, seen
    seen = {}
    for n in (1000, 4000):  # a cluster for every 25 rows
        v = clustered(n, n // 25, 16, 0.02)
        q = base_frame(spark, v)
        got = nearest_indexed(q.select(F.col("ordinal").alias("id"), "vector"), q, True, rows=50).agg(F.sum("compared")).first()[0]
        seen[n] = got
    assert seen[4000] < 10 * seen[1000] and seen[4000] < 4000 * 4000 / 8, seen


@pytest.mark.parametrize("rows,cells", [(32, None), (64, 7), (1000, 1), (16, 60)])
def test_indexed_neighbours_equal_a_scan(spark, rows, cells):
    v = clustered(400)
    v[7] = v[3]
    v[50] = 0
    base = base_frame(spark, v)
    queries = base.select(F.col("ordinal").alias("id"), "vector").unionByName(spark.createDataFrame([(None, [float(x) for x in v[5]]), (9999, None)], "id long, vector array<double>"))
    got = {r.id: r for r in nearest_indexed(queries.filter("id is not null"), base, True, rows, cells).collect()}
    want = {r.id: r for r in nearest(queries.filter("id is not null"), base, True).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].near == w.near and got[k].near_word == w.near_word, k
        assert (got[k].sim is None) == (w.sim is None) and (w.sim is None or abs(got[k].sim - w.sim) < 1e-12)
    free = {r.id: r.near for r in nearest_indexed(queries, base, False, rows, cells).collect()}
    assert free[None] == 5 and free[9999] is None and free[3] == 3 and free[7] == 3


def test_redundancy_through_cells_equals_the_plain_rule(spark):
    v = clustered(300, 20, 8, 0.15)
    s = clustered(300, 30, 6, 0.2, 9)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], s[i]) for i in range(300)])
    sim = np.maximum(v @ v.T, s @ s.T)
    kept = []
    for i in range(300):
        if not any(sim[i, j] > 0.9 for j in kept):
            kept.append(i)
    got = S.drop_redundant(df, 0.9, small=8, rows=32).select("ordinal").collect()
    assert sorted(r.ordinal for r in got) == kept and len(kept) < 250


@pytest.mark.parametrize("gate,largest", [("visual", True), ("semantic", False), ("joint", True), ("either_distinct", False), ("gap", True)])
def test_extreme_pairs_through_cells_equal_all_pairs(spark, gate, largest):
    v, s, has = mixed(180, 21)
    df = vector_frame(spark, [("abc"[i % 3], i, f"w{i}", v[i], s[i] if has[i] else None) for i in range(180)])
    sim = gates(v @ v.T, s @ s.T, has)[gate]
    pairs = [((-1 if largest else 1) * round(sim[i, j], 10), i, j) for i in range(180) for j in range(i + 1, 180) if i % 3 != j % 3]
    got = top_pairs(df, gate, 12, largest, differ="category", rows=24).collect()
    scores = [r.score for r in got]
    assert np.allclose(scores, [(-1 if largest else 1) * p[0] for p in sorted(pairs)[:12]])
    assert all(r.ordinal_a % 3 != r.ordinal_b % 3 and abs(sim[r.ordinal_a, r.ordinal_b] - r.score) < 1e-12 for r in got)
    many = top_pairs(df.filter("ordinal < 30"), gate, 1000, largest, rows=8).count()
    assert many == 30 * 29 // 2


def test_extreme_pairs_open_few_tiles(spark):
    v = clustered(2000, 20, 8, 0.02)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], None) for i in range(2000)])
    index = Cells(df, "ordinal", 50)
    best = top_pairs(df, "visual", 10, True, rows=50).collect()
    assert compared(index.tiles(df, [], "visual", best[-1].score), []) < 0.25 * 2000 * 2000 / 2


def test_distant_pairs_through_cells_equal_the_greedy_list(spark):
    v, s, _ = mixed(150, 33)
    v, s = v[14:], s[14:]
    n = len(v)
    df = vector_frame(spark, [("abc"[i % 3], i, f"w{i}", v[i], s[i]) for i in range(n)])
    sim = s @ s.T
    used, want = set(), []
    for x, i, j in sorted((sim[i, j], i, j) for i in range(n) for j in range(i + 1, n) if i % 3 != j % 3):
        if i not in used and j not in used and len(want) < 8:
            used |= {i, j}
            want.append((f"w{i}", f"w{j}"))
    got = S.distant_pairs(df, 8, rows=20).orderBy("rank").collect()
    assert [(r.word_a, r.word_b) for r in got] == want
    everything = S.distant_pairs(df.filter("ordinal < 12"), 50, rows=4).count()
    assert everything == S.distant_pairs(df.filter("ordinal < 12"), 50).count()


@pytest.mark.parametrize("gate,linkage", [("either_distinct", "min"), ("visual", "max"), ("semantic", "max"), ("joint", "min"), ("gap", "min")])
def test_lazy_picks_equal_the_walk(spark, gate, linkage):
    v, s, has = mixed(160, 40)
    v[10:14] += np.random.default_rng(1).normal(size=(4, 5)) * 0.01  # products of copies may round apart
    rows = [("ab"[i % 2], i, f"w{i}", v[i], s[i] if has[i] else None) for i in range(160)]
    df = vector_frame(spark, rows).repartition(4)
    small = {(r.category, r["rank"]): (r.ordinal, r.similarity) for r in S.diverse_words(df, 9, gate, linkage).collect()}
    large = {(r.category, r["rank"]): (r.ordinal, r.similarity) for r in S.diverse_words(df, 9, gate, linkage, small=8, rows=16).collect()}
    assert {k: x[0] for k, x in large.items()} == {k: x[0] for k, x in small.items()} and len(small) == 18
    assert all(x[1] is None or abs(x[1] - small[k][1]) < 1e-12 for k, x in large.items())


def test_lazy_picks_open_few_tiles(spark, monkeypatch):
    """Linkage by the greatest similarity: clusters that hold a pick cannot win, so their tiles stay closed."""
    v = clustered(1200, 40, 8, 0.02, 11)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], None) for i in range(1200)])
    seen, plain = [], S.tile_state

    def counted(*args):
        out = plain(*args)
        seen.append(out)
        return out

    monkeypatch.setattr(S, "tile_state", counted)
    S.diverse_words(df, 15, "visual", "max", small=8, rows=20).count()
    products = [x.agg({"opened": "sum"}).first()[0] for x in seen]
    assert products[0] == 1200 and sum(products) <= 0.6 * 15 * 1200, products
