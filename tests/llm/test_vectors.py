import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import negatives, whitening

ODD = [None, [], [1.0, None], [math.nan, 1.0], [math.inf, 0.0], [-math.inf, 0.0]]


def spectrum(d, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize("values", [np.arange(40.0, 0, -1), np.r_[np.full(5, 3.0), np.full(7, 1.0)], np.r_[1e6, 10, 1, 1e-3, 1e-6, 0, 0], np.ones(9), np.r_[1 + 1e-9, 1, 0.5], np.zeros(4), np.ones(1)])
def test_divide_and_conquer_gives_eigenpairs(values):
    d = len(values)
    a, _ = spectrum(d, values)
    for wanted in (d, min(3, d)):
        e, u = whitening.components(a, wanted)
        assert np.allclose(e, np.sort(values)[::-1][:wanted], rtol=0, atol=1e-12 * max(values.max(), 1e-300))
        assert np.allclose(u.T @ u, np.eye(wanted), atol=1e-13)
        assert np.abs(a @ u - u * e).max() <= 1e-12 * max(values.max(), 1e-300)


def test_polar_factor_is_the_sign():
    a, q = spectrum(12, np.r_[np.linspace(-3, -1e-7, 6), np.linspace(1e-7, 5, 6)])
    assert np.allclose(whitening.polar(a), (q * np.r_[-np.ones(6), np.ones(6)]) @ q.T, atol=1e-7)


def plain(rows, wanted=32):
    x = np.array([[math.floor(64 * c) + 1000000 for c in r] for r in rows], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True))) for r in x]
    y = np.array([[float((n * v - t)) / n for v, t in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


@pytest.mark.parametrize("n,d,offset", [(300, 12, 0.0), (400, 40, 1e6), (90, 3, -7.3)])
def test_whitening_equals_numpy(spark, n, d, offset):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + offset
    rows = [(k, r.tolist(), k % 3, "x") for k, r in enumerate(v)] + [(1000 + k, x, 0, "y") for k, x in enumerate(ODD)] + [(2000, [1.0], 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, i string").repartition(5)
    got = {r.vec_id: r for r in whitening.whiten(df).collect()}
    assert set(got) == set(range(n))
    m, deviation, want, explained = plain(v.tolist())
    w = np.array([got[k].whitened for k in range(n)])
    assert w.shape == want.shape
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-8)
    assert [got[k].deviation for k in range(n)] == deviation and {r.n for r in got.values()} == {m}
    assert np.allclose(got[0].explained, explained, rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got.values())


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, x) for x in ODD], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(3, 0, [])] * 3
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 5.0, -float(k)]) for k in range(9)], schema)).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in flat)
    # A square beyond 64 bits in numpy's integers is still exact.
    far = whitening.whiten(spark.createDataFrame([(0, [0.0]), (1, [500000.0])], schema)).collect()
    assert [r.deviation for r in far] == [32000000**2] * 2
    with pytest.raises(Exception, match="exact"):
        whitening.whiten(spark.createDataFrame([(0, [0.0]), (1, [1e300])], schema)).collect()


def brute(rows, every, positives=5, k=5, low=80, scale=256):
    v = {}
    for i, x, label in sorted(rows, key=lambda r: (r[0] is None, r[0], r[2] is None, r[2])):
        if i is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, ([math.floor(scale * c) for c in x], label))
    out = set()
    for a, (x, label) in v.items():
        if a % every:
            continue
        s = sorted(((-sum(p * q for p, q in zip(x, y)), i) for i, (y, _) in v.items() if i != a))
        for p, i in [t for t in s if v[t[1]][1] == label][:positives]:
            hits = [(q, j) for q, j in s if v[j][1] != label and low * -p <= 100 * -q <= 100 * -p][:k]
            out |= {(a, i, r + 1, j, -p, -q) for r, (q, j) in enumerate(hits)}
    return out


@pytest.mark.parametrize("d,spread,block,tile", [(6, 0.3, 64, 8), (3, 2.0, 50, 16), (20, 0.1, 8192, 1024), (2, 0.004, 33, 5)])
def test_negatives_equal_brute_force(spark, d, spread, block, tile):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(600):
        x = centres[i % 6] + rng.normal(size=d) * spread
        rows.append((i, np.round(x, 2).tolist(), int(rng.integers(0, 4))))
    rows += [(600 + k, rows[5][1], k % 3) for k in range(60)]  # many equal vectors, so ties
    rows += [(900 + k, x, 1) for k, x in enumerate(ODD)] + [(None, rows[0][1], 1), (1000, rows[1][1], None), (1100, [0.0] * d, 2), (1200, [1.0], 2)]
    rows += [rows[0], (0, rows[7][1], 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, score int").repartition(4)
    got = negatives.mine(df, F.col("id") % 20 == 0, df["label"], block=block, tile=tile)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 20)
    assert found or d == 2


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    mine = lambda rows: negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % 1 == 0, F.col("label")).count()
    assert mine([]) == 0
    assert mine([(1, [1.0], 0)]) == 0
    assert mine([(k, [1.0], 0) for k in range(5)]) == 0  # one label: no negatives
    assert mine([(k, [1.0], k) for k in range(5)]) == 0  # each its own label: no positives
    assert mine([(k, [1.0], k % 2) for k in range(8)]) == 8 * 3 * 4


def test_reading_stops_early_where_the_threshold_allows():
    rng = np.random.default_rng(1)
    x = np.floor(rng.pareto(2.0, size=(5000, 3)) * 50)
    lists = negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), x)
    anchor = np.array([3.0, 1.0, 2.0])
    ids, scores, n = negatives.search(lists, anchor, np.ones(5000, bool), lists.thresholds(anchor[None])[0], [], 5)
    want = sorted(range(5000), key=lambda i: (-(x[i] @ anchor), i))[:5]
    assert ids[0].tolist() == want and n < 500


def test_scores_beyond_53_bits_are_exact():
    x = np.array([[2.0**27 + 1, 1.0], [2.0**27, 2.0**27]])
    lists = negatives.Lists(np.arange(2), np.zeros(2, np.int64), x)
    assert lists.scores(np.arange(2), np.array([2.0**27 + 1, 3.0])).tolist() == [(2**27 + 1) ** 2 + 3, 2**27 * (2**27 + 1) + 3 * 2**27]
