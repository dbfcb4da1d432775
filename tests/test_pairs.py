import numpy as np
import pytest
from helpers import unit_rows, vector_frame
from pyspark.sql import functions as F

from wordloom.operators import diversity as D
from wordloom.operators import moments as M
from wordloom.operators.nearest import nearest
from wordloom.operators.pairs import pair_stats, top_pairs

GATES = {
    "visual": lambda v, s: v,
    "semantic": lambda v, s: s,
    "joint": lambda v, s: 0.3 * v + 0.7 * s,
    "either_similar": np.maximum,
    "either_distinct": np.minimum,
}


@pytest.mark.parametrize("rows", [4096, 9])
def test_pair_stats_match_brute_force(pool, rows):
    df, arrays = pool
    got = {(r["category"], r["gate"]): r for r in pair_stats(df, ["category"], list(GATES), 0.3, 0.4, rows).collect()}
    for c, (ords, v, s) in arrays.items():
        i, j = np.triu_indices(len(ords), 1)
        for g, f in GATES.items():
            x = f(v @ v.T, s @ s.T)[i, j]
            r = got[c, g]
            assert (r["count"], r["pairs"], r["redundant_pairs"]) == (len(ords), len(x), (x > 0.4).sum())
            np.testing.assert_allclose(
                [r["mean_similarity"], r["std_similarity"], r["min_similarity"], r["max_similarity"]], [x.mean(), x.std(), x.min(), x.max()], atol=1e-9
            )
            assert (r["most_similar"]["i"], r["most_similar"]["j"]) == (ords[i[x.argmax()]], ords[j[x.argmax()]])
            assert (r["most_distant"]["i"], r["most_distant"]["j"]) == (ords[i[x.argmin()]], ords[j[x.argmin()]])


def test_tiny_groups_and_missing_space(spark):
    v = unit_rows(3, 4)
    df = vector_frame(spark, [("one", 0, "w", v[0], None), ("two", 1, "x", v[1], None), ("two", 2, "y", v[2], None)])
    got = {r["category"]: r for r in D.diversity(df, "joint").collect()}
    assert got["one"]["count"] == 1 and got["one"]["mean_similarity"] is None and got["one"]["redundant_pairs"] == 0
    assert abs(got["two"]["mean_similarity"] - v[1] @ v[2]) < 1e-9
    zero = {r["category"]: r for r in D.spread_or_zero(df, "semantic", ["category"]).collect()}
    assert (zero["one"]["mean"], zero["one"]["std"], zero["one"]["range"]) == (0, 0, 0)
    w = {r["category"]: r for r in D.space_weights(df).collect()}
    assert w["two"]["alpha"] == 1.0


def test_ties_go_to_the_first_pair(spark):
    e = np.eye(3)
    df = vector_frame(spark, [("t", 10 + i, f"w{i}", e[i % 3], e[i % 3]) for i in range(6)])
    for rows in (4096, 2):
        r = pair_stats(df, ["category"], ["visual"], rows=rows).first()
        assert (r["most_similar"]["i"], r["most_similar"]["j"]) == (10, 13)
        assert (r["most_distant"]["i"], r["most_distant"]["j"]) == (10, 11)
        top = [(t["ordinal_a"], t["ordinal_b"]) for t in top_pairs(df, "visual", 4, True, rows=rows).collect()]
        assert top == [(10, 13), (11, 14), (12, 15), (10, 11)]


def test_moments_match_pairs(pool):
    df, arrays = pool
    got = {r["category"]: r for r in D.space_correlation(df).collect()}
    std = {r["category"]: r for r in D.spread_by_moments(df).collect()}
    xs, ys = [], []
    for c, (ords, v, s) in arrays.items():
        i, j = np.triu_indices(len(ords), 1)
        x, y = (v @ v.T)[i, j], (s @ s.T)[i, j]
        xs.append(x), ys.append(y)
        assert abs(got[c]["pearson_r"] - np.corrcoef(x, y)[0, 1]) < 1e-8
        assert abs(std[c]["visual_std"] - x.std()) < 1e-9 and abs(std[c]["semantic_std"] - y.std()) < 1e-9
    assert abs(got[None]["pearson_r"] - np.corrcoef(np.concatenate(xs), np.concatenate(ys))[0, 1]) < 1e-8


def test_partial_sums_flush(pool, monkeypatch):
    df, arrays = pool
    monkeypatch.setattr(M, "HELD_DOUBLES", 1)
    got = {r["category"]: r for r in M.centroids(df.repartition(5), ["category"]).collect()}
    for c, (ords, v, s) in arrays.items():
        m = v.mean(axis=0)
        np.testing.assert_allclose(got[c]["visual"], m / np.linalg.norm(m), atol=1e-9)
        assert (got[c]["n"], got[c]["first"]) == (len(ords), ords[0])


@pytest.mark.parametrize("kw", [{}, {"broadcast_bytes": 0, "rows": 11}])
def test_nearest(pool, kw):
    df, arrays = pool
    ords = np.concatenate([a[0] for a in arrays.values()])
    v = np.concatenate([a[1] for a in arrays.values()])
    sim = v @ v.T
    np.fill_diagonal(sim, -9)
    q = df.select(F.col("ordinal").alias("id"), F.col("visual").alias("vector"))
    b = df.select("ordinal", "word", F.col("visual").alias("vector"))
    got = {r["id"]: (r["near"], r["sim"]) for r in nearest(q, b, exclude_self=True, **kw).collect()}
    assert {k: x[0] for k, x in got.items()} == dict(zip(ords, ords[sim.argmax(axis=1)]))


def test_cross_spread(pool):
    df, arrays = pool
    a, b = arrays["a"][1], np.concatenate([arrays["b"][1], arrays["c"][1]])
    r = D.cross_spread(df.filter("category = 'a'"), df.filter("category <> 'a'"), rows=10).first()
    np.testing.assert_allclose([r["mean"], r["min"], r["max"]], [(a @ b.T).mean(), (a @ b.T).min(), (a @ b.T).max()], atol=1e-9)


def test_principal_axes(pool):
    df, arrays = pool
    rows = D.principal_axes(df, 2).orderBy("ordinal").collect()
    v = np.concatenate([a[1] for a in arrays.values()])
    x = v - v.mean(axis=0)
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    for k in range(2):
        ax = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        np.testing.assert_allclose([r[f"axis_{k + 1}"] for r in rows], x @ ax, atol=1e-6)
        assert abs(rows[0][f"explained_{k + 1}"] - s[k] ** 2 / (s**2).sum()) < 1e-6
