import numpy as np
import pytest
from helpers import vector_frame
from pyspark.sql import functions as F

from wordloom.operators import centroids as C

PATHS = [{}, {"broadcast_bytes": 0, "rows": 7}]


def unit(v):
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("kw", PATHS)
def test_contamination(pool, kw):
    df, arrays = pool
    cats = list(arrays)
    cv = np.stack([unit(arrays[c][1].mean(axis=0)) for c in cats])
    cs = np.stack([unit(arrays[c][2].mean(axis=0)) for c in cats])
    want = {}
    for k, c in enumerate(cats):
        ords, v, s = arrays[c]
        joint = 0.3 * v @ cv.T + 0.7 * s @ cs.T
        for i, o in enumerate(ords):
            if joint[i].argmax() != k:
                want[int(o)] = (cats[joint[i].argmax()], joint[i].max() - joint[i, k])
    got = {r["ordinal"]: (r["closest"], r["delta"]) for r in C.contamination(df, 0.3, **kw).collect()}
    assert got.keys() == want.keys() and all(got[o][0] == want[o][0] and abs(got[o][1] - want[o][1]) < 1e-9 for o in got)


@pytest.mark.parametrize("kw", PATHS)
def test_one_space_only(spark, kw):
    e = np.eye(2)
    rows = [("a", 0, "a0", e[0], None), ("a", 1, "a1", e[0], None), ("a", 2, "stray", e[1], None), ("b", 3, "b0", e[1], None)]
    df = vector_frame(spark, rows)
    assert [r["word"] for r in C.proposed_moves(df, **kw).collect()] == ["stray"]
    conf = {r["word"]: r for r in C.word_confidence(df.withColumn("pool", F.lit("p")), **kw).collect()}
    assert conf["stray"]["quadrant"] == "semantic_anchor" and conf["stray"]["semantic_confidence"] == 0.0
    assert conf["a0"]["quadrant"] == "rock_solid"


@pytest.mark.parametrize("kw", PATHS)
def test_tie_goes_to_the_first_category(spark, kw):
    e = np.eye(3)
    rows = [("b", 0, "w0", e[0], e[0]), ("a", 1, "w1", e[0], e[0]), ("c", 2, "w2", e[1], e[1])]
    got = {r["word"]: r["says_visual"] for r in C.closest_centroids(vector_frame(spark, rows), **kw).collect()}
    assert got == {"w0": "b", "w1": "b", "w2": "c"}


def test_reallocation_replay(spark):
    """A word two categories want to move: the first move wins, the second finds the target taken."""
    e = np.eye(3)
    rows = [("x", i, f"x{i}", e[0], e[0]) for i in range(6)] + [("y", 10 + i, f"y{i}", e[1], e[1]) for i in range(6)]
    rows += [("z", 20 + i, f"z{i}", e[2], e[2]) for i in range(6)]
    rows += [("x", 7, "twice", e[2], e[2]), ("y", 17, "twice", e[2], e[2]), ("x", 8, "there", e[2], e[2]), ("z", 27, "there", e[2], e[2])]
    got = C.reallocate(vector_frame(spark, rows))
    places = sorted((r["word"], r["category"], r["moved"]) for r in got.filter("word in ('twice', 'there')").collect())
    assert places == [("there", "x", False), ("there", "z", False), ("twice", "y", False), ("twice", "z", True)]
    last = got.filter("category = 'z'").orderBy(F.desc("ordinal")).first()
    assert last["word"] == "twice" and got.count() == len(rows)


def test_only_the_first_copy_moves(spark):
    e = np.eye(2)
    rows = [("x", i, f"x{i}", e[0], e[0]) for i in range(9)] + [("y", 20 + i, f"y{i}", e[1], e[1]) for i in range(3)]
    rows += [("x", 10 + i, "copy", e[1], e[1]) for i in range(3)]
    got = C.reallocate(vector_frame(spark, rows)).filter("word = 'copy'").orderBy("ordinal").collect()
    assert [(r["category"], r["moved"]) for r in got] == [("x", False), ("x", False), ("y", True)]


def test_zero_centroid_stays_zero(spark):
    v = np.array([1.0, 0.0])
    df = vector_frame(spark, [("a", 0, "p", v, v), ("a", 1, "q", -v, -v)])
    assert C.centroids(df, ["category"]).first()["visual"] == [0.0, 0.0]


def test_isolation_and_gaps(pool):
    df, arrays = pool
    cats = list(arrays)
    cv = np.stack([unit(arrays[c][1].mean(axis=0)) for c in cats])
    cs = np.stack([unit(arrays[c][2].mean(axis=0)) for c in cats])
    iso = {r["category"]: r["visual_avg"] for r in C.isolation(df).collect()}
    m = cv @ cv.T
    for k, c in enumerate(cats):
        assert abs(iso[c] - (m[k].sum() - 1) / (len(cats) - 1)) < 1e-9
    both = (cv @ cv.T + cs @ cs.T)[np.triu_indices(3, 1)]
    top = C.category_extremes(df, 1, True).first()
    assert abs(top["sim_visual"] + top["sim_semantic"] - both.max()) < 1e-9
    gap = C.space_disagreement(df, 3).collect()
    assert [round(r["delta"], 9) for r in gap] == sorted(np.round(np.abs((cv @ cv.T - cs @ cs.T)[np.triu_indices(3, 1)]), 9), reverse=True)
