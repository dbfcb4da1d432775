"""Spread over pairs without meeting them: the same numbers as by all pairs."""

import numpy as np
import pytest

from helpers import unit_rows, vector_frame
from wordloom.operators import extremes as X
from wordloom.operators import tiles as T
from wordloom.operators.pairs import pair_stats
from wordloom.plans import profile as PF

GATES = ["visual", "semantic", "joint"]


@pytest.fixture(scope="module")
def rows():
    out = []
    for c, n in (("a", 150), ("b", 60), ("c", 1), (None, 7)):
        v, s = unit_rows(n, 40, n) + 0.2, unit_rows(n, 5, n + 5) + 0.1
        out += [(c, len(out) + i, f"{c}{i}", v[i], s[i]) for i in range(n)]
    twice = out[155]
    return out + [("b", len(out) + k, "x", twice[3], twice[4]) for k in range(3)]


def _close(got, want):
    assert got.keys() == want.keys()
    for k, row in want.items():
        for x, y in zip(got[k], row, strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, abs=1e-12), k


@pytest.mark.parametrize("size", [{}, {"rows": 32, "leaf": 8}])
def test_spread_is_that_of_all_pairs(spark, rows, size):
    df = vector_frame(spark, rows).cache()
    got = X.pair_spread(df, ["category"], GATES, 0.3, whole=True, **size)
    full = pair_stats(df, ["category"], GATES, 0.3).select("category", *X.STATS)
    _close({tuple(r)[:2]: tuple(r)[2:] for r in got.groups.collect()}, {tuple(r)[:2]: tuple(r)[2:] for r in full.collect()})
    every = pair_stats(df, [], GATES, 0.3).select(*X.STATS)
    _close({r.gate: tuple(r)[1:] for r in got.whole.collect()}, {r.gate: tuple(r)[1:] for r in every.collect()})
    sums = {r.category: np.array(r.visual) for r in got.sums.collect()}
    np.testing.assert_allclose(sums["a"], sum(r[3] for r in rows if r[0] == "a"))


def test_rows_without_a_vector_meet_one_by_one(spark, rows):
    df = vector_frame(spark, [(*r[:4], None if r[1] % 9 == 0 else r[4]) for r in rows if r[0] == "b"])
    got = X.pair_spread(df, ["category"], ["joint"], 0.3).groups.collect()
    want = pair_stats(df, ["category"], ["joint"], 0.3).select("category", *X.STATS).collect()
    assert tuple(got[0])[3:] == pytest.approx(tuple(want[0])[3:], abs=1e-12)


@pytest.fixture
def prompts(spark, monkeypatch):
    """Vectors of 2,000 prompts a template; an error where all pairs would be made."""

    def no(*_, **__):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(T, "pairwise", no)
    words = ["oak", "iron", "salt", "fog", "silk", "rust", "clay", "moss", "ash", "tar", "bone", "glass", "wax", "lead"]
    comp = spark.createDataFrame([(c, i * 100 + j, f"{w} {c}") for i, c in enumerate("ab") for j, w in enumerate(words)], "category string, ordinal bigint, word string")
    t = spark.createDataFrame([("t1", "{a:3:, } and {b}", ["a", "b"], ""), ("t2", "{b:2}, {a:2}", ["a"], "")], "id string, structure string, required_components array<string>, notes string")
    return t, comp, PF.sample_vectors(t, comp, 2000).cache()


def _similarities(rows):
    v, s = (np.array([r[k] for r in rows]) for k in ("visual", "semantic"))
    i, j = np.triu_indices(len(v), 1)
    return (v @ v.T)[i, j], (s @ s.T)[i, j]


def test_profiles_make_no_pairs(prompts):
    t, comp, vectors = prompts
    rows = vectors.collect()
    for p in PF.profile_templates(t, comp, 0, vectors=vectors).collect():
        v, s = _similarities([r for r in rows if r["template_id"] == p["template_id"]])
        for g, x in (("visual", v), ("semantic", s)):
            assert p[f"{g}_internal_mean"] == pytest.approx(x.mean(), abs=1e-9)
            assert p[f"{g}_internal_range"] == pytest.approx(x.max() - x.min(), abs=1e-9)


def test_prompt_diversity_makes_no_pairs(prompts):
    rows = prompts[2].collect()
    got = {r["template_id"]: r for r in PF.prompt_diversity(prompts[2]).collect()}
    assert got.keys() == {"t1", "t2", None}
    for k, r in got.items():
        v, s = _similarities([x for x in rows if k in (None, x["template_id"])])
        x = 0.5 * v + 0.5 * s
        assert (r["mean_similarity"], r["min_similarity"], r["max_similarity"]) == pytest.approx((x.mean(), x.min(), x.max()), abs=1e-9)
