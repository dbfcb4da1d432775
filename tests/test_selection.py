import numpy as np
import pytest
from helpers import unit_rows, vector_frame

from wordloom.operators import selection as S
from wordloom.plans.select_pools import select_pools

PATHS = [{}, {"small": 3, "rows": 8}]  # one task per group, rounds over tiles


@pytest.fixture(scope="module")
def tied(spark):
    """Many exact copies: a third of the rows share one vector."""
    base = unit_rows(20, 4, 3)
    v = np.concatenate([base, np.repeat(base[:1], 10, axis=0)])
    order = np.random.default_rng(1).permutation(len(v))
    v = v[order]
    return vector_frame(spark, [("t", i, f"w{i}", v[i], v[i]) for i in range(len(v))]), {"t": (np.arange(len(v)), v, v)}


def scan(sim, thr):
    kept = []
    for i in range(len(sim)):
        if all(sim[k, i] <= thr for k in kept):
            kept.append(i)
    return kept


def walk(sim, k, start, fold):
    n, chosen = len(sim), list(start)
    if k >= n and start == [0]:
        return list(range(n))
    while len(chosen) < min(k, n):
        cur = {w: fold(sim[c, w] for c in chosen) for w in range(n) if w not in chosen}
        chosen.append(min(cur, key=lambda w: (cur[w], w)))
    return chosen


def pairing(sim):
    n, free, mate = len(sim), set(range(len(sim))), {}
    while len(free) > 1:
        i, j = min(((i, j) for i in free for j in free if i < j), key=lambda p: (sim[p], p))
        mate[i], mate[j] = j, i
        free -= {i, j}
    for last in free:
        if n > 1:
            mate[last] = min((w for w in range(n) if w != last), key=lambda w: (sim[last, w], w))
    return mate


@pytest.mark.parametrize("kw", PATHS)
@pytest.mark.parametrize("which", ["pool", "tied"])
@pytest.mark.parametrize("thr", [0.3, 0.6])
def test_redundancy(request, which, kw, thr):
    df, arrays = request.getfixturevalue(which)
    got = S.mark_redundant(df, thr, **kw).collect()
    assert len(got) == sum(len(a[0]) for a in arrays.values())
    for c, (ords, v, s) in arrays.items():
        want = {int(ords[i]) for i in scan(np.maximum(v @ v.T, s @ s.T), thr)}
        assert {r["ordinal"] for r in got if r["category"] == c and r["kept"]} == want


def test_redundancy_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each word is alike to its neighbours only, so which words are kept hangs on the first one."""
    a = np.arange(240) * 2 * np.pi / 480
    v = np.stack([np.cos(a), np.sin(a)], axis=1)
    df = vector_frame(spark, [("c", i, f"w{i}", v[i], v[i]) for i in range(240)])
    cuts, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda x: cuts.append(1) or cut(x))
    got = S.drop_redundant(df, float(np.cos(a[1] * 1.5)), small=8, rows=16).select("ordinal").collect()
    assert sorted(r.ordinal for r in got) == list(range(0, 240, 2))
    assert len(cuts) <= 40


@pytest.mark.parametrize("kw", PATHS)
def test_chain_keeps_both_ends(spark, kw):
    a = np.deg2rad([0, 30, 60, 90, 120])
    v = np.stack([np.cos(a), np.sin(a)], axis=1)
    df = vector_frame(spark, [("c", i, f"w{i}", v[i], v[i]) for i in range(5)])
    got = S.drop_redundant(df, 0.8, **kw).orderBy("ordinal").collect()
    assert [r["word"] for r in got] == ["w0", "w2", "w4"]


@pytest.mark.parametrize("kw", PATHS)
@pytest.mark.parametrize("linkage", ["min", "max"])
@pytest.mark.parametrize("which", ["pool", "tied"])
def test_diverse_words(request, which, linkage, kw):
    df, arrays = request.getfixturevalue(which)
    got = S.diverse_words(df, 8, linkage=linkage, **kw).collect()
    for c, (ords, v, s) in arrays.items():
        want = walk(np.minimum(v @ v.T, s @ s.T), 8, [0], min if linkage == "min" else max)
        ranked = sorted((r["rank"], r["ordinal"]) for r in got if r["category"] == c)
        assert [o for _, o in ranked] == [int(ords[i]) for i in want]


@pytest.mark.parametrize("kw", PATHS)
def test_diverse_words_from_seeds(spark, pool, kw):
    df, arrays = pool
    seeds = spark.createDataFrame([("a", 7), ("a", 3)], "category string, ordinal bigint")
    got = S.diverse_words(df, 6, seeds=seeds, **kw).filter("category = 'a'").orderBy("rank").collect()
    ords, v, s = arrays["a"]
    assert [r["ordinal"] for r in got] == [int(ords[i]) for i in walk(np.minimum(v @ v.T, s @ s.T), 6, [3, 7], min)]


def test_no_words_asked_for(pool):
    assert S.diverse_words(pool[0], 0).count() == 0


def elbow_size(sim, max_k):
    n = len(sim)
    if n < 4:
        return n
    off = sim + np.where(np.eye(n, dtype=bool), np.inf, 0)
    start = [int(x) for x in np.unravel_index(off.argmin(), off.shape)]
    path = walk(sim, min(max_k, n), start, min)
    d = [1 - min(sim[c, path[i]] for c in path[:i]) for i in range(2, len(path))]
    if len(d) < 3:
        return len(d) + 2
    return int(np.argmax([a - b for a, b in zip(d, d[1:])])) + 3


@pytest.mark.parametrize("kw", PATHS)
def test_elbow(spark, kw):
    sizes, rows, arrays = {"z1": 1, "z2": 2, "z3": 3, "z4": 4, "z9": 9, "z30": 30}, [], {}
    for n, (c, k) in enumerate(sizes.items()):
        v = unit_rows(k, 4, 50 + n)
        arrays[c] = v @ v.T
        rows += [(c, 100 * n + i, f"{c}{i}", v[i], v[i]) for i in range(k)]
    got = {r["category"]: r["elbow_k"] for r in S.elbow(vector_frame(spark, rows), 12, **kw).collect()}
    assert got == {c: elbow_size(m, 12) for c, m in arrays.items()}


@pytest.mark.parametrize("kw", PATHS)
@pytest.mark.parametrize("which", ["pool", "tied"])
def test_opposites(request, which, kw):
    df, arrays = request.getfixturevalue(which)
    got = {r["word"]: r["opposite"] for r in S.opposite_pairs(df, **kw).collect()}
    words = {(r["category"], r["ordinal"]): r["word"] for r in df.collect()}
    want = {}
    for c, (ords, v, s) in arrays.items():
        want |= {words[c, int(ords[i])]: words[c, int(ords[j])] for i, j in pairing(s @ s.T).items()}
    assert got == want


def test_opposites_of_many_copies_need_few_rounds(spark, monkeypatch):
    """Classes of equal vectors are paired as wholes, so copies do not cost a round each."""
    base = unit_rows(6, 4, 8)
    v = np.repeat(base, [60, 1, 2, 20, 5, 9], axis=0)[np.random.default_rng(2).permutation(97)]
    df = vector_frame(spark, [("t", i, f"w{i}", v[i], v[i]) for i in range(97)])
    rounds = []
    inner = S._best_classes
    monkeypatch.setattr(S, "_best_classes", lambda *a: rounds.append(1) or inner(*a))
    got = {r["word"]: r["opposite"] for r in S.opposite_pairs(df, small=3, rows=4).collect()}
    sim = np.round(v @ v.T, 12)  # equal vectors must tie exactly in the plain rule too
    assert got == {f"w{i}": f"w{j}" for i, j in pairing(sim).items()}
    assert len(rounds) <= 10


def test_opposites_with_ties_between_classes(spark):
    e = np.eye(3)
    which = [0, 1, 2, 0, 1, 0, 2, 1, 0, 0, 2]
    df = vector_frame(spark, [("t", i, f"w{i}", e[k], e[k]) for i, k in enumerate(which)])
    v = e[which]
    want = {f"w{i}": f"w{j}" for i, j in pairing(v @ v.T).items()}
    for kw in PATHS:
        assert {r["word"]: r["opposite"] for r in S.opposite_pairs(df, **kw).collect()} == want


def test_opposites_of_different_words_need_few_rounds(spark, monkeypatch):
    """Lists of partners prove most choices, so words without copies do not wait for each other round by round."""
    v = unit_rows(151, 12, 5)
    df = vector_frame(spark, [("t", i, f"w{i}", v[i], v[i]) for i in range(151)])
    rounds = []
    inner = S._best_classes
    monkeypatch.setattr(S, "_best_classes", lambda *a: rounds.append(1) or inner(*a))
    got = {r["word"]: r["opposite"] for r in S.opposite_pairs(df, small=3, rows=64).collect()}
    assert got == {f"w{i}": f"w{j}" for i, j in pairing(v @ v.T).items()}
    assert len(rounds) <= 2


@pytest.mark.parametrize("rows", [4096, 8])
@pytest.mark.parametrize("n", [1, 6, 40])
def test_distant_pairs(pool, rows, n):
    df, arrays = pool
    cat = np.concatenate([[c] * len(a[0]) for c, a in arrays.items()])
    s = np.concatenate([a[2] for a in arrays.values()])
    sim, used, want = s @ s.T, set(), []
    edges = sorted((sim[i, j], i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if cat[i] != cat[j])
    for _, i, j in edges:
        if len(want) < n and not used & {i, j}:
            used |= {i, j}
            want.append((i, j))
    names = [r["word"] for r in df.orderBy("ordinal").collect()]
    got = S.distant_pairs(df, n, rows=rows).orderBy("rank").collect()
    assert [(r["word_a"], r["word_b"]) for r in got] == [(names[i], names[j]) for i, j in want]


def test_distant_pairs_with_copies(spark):
    """One word is least similar to many equal copies: ties must not hide the later pairs."""
    up, side = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    rows = [("x", 0, "x0", up, up), ("x", 1, "x1", side, side)] + [("y", 2 + i, f"y{i}", -up, -up) for i in range(30)]
    df = vector_frame(spark, rows)
    for size in (4096, 7):
        got = S.distant_pairs(df, 2, rows=size).orderBy("rank").collect()
        assert [(r["word_a"], r["word_b"]) for r in got] == [("x0", "y0"), ("x1", "y1")]


def test_gated_selection_is_the_composition(pool):
    df, arrays = pool
    s = select_pools(df, 5, 0.6, move=False, negatable=["a"])
    summary = {r["category"]: r for r in s.summary.collect()}
    picked = s.selected.orderBy("category", "rank").collect()
    for c, (ords, v, t) in arrays.items():
        kept = scan(np.maximum(v @ v.T, t @ t.T), 0.6)
        sel = np.minimum(v @ v.T, t @ t.T)[np.ix_(kept, kept)]
        path = walk(sel, 5, [0], min)
        mine = [r for r in picked if r["category"] == c]
        assert [r["ordinal"] for r in mine] == [int(ords[kept[i]]) for i in path]
        assert summary[c]["after_filter"] == len(kept) and summary[c]["redundant_dropped"] == len(ords) - len(kept)
        assert summary[c]["elbow_k"] == elbow_size(sel, 25)
        final = [kept[i] for i in path]
        mates = {i: j for i, j in pairing((t @ t.T)[np.ix_(final, final)]).items()} if c == "a" else {}
        assert [r["opposite"] for r in mine] == [mine[mates[i]]["word"] if i in mates else None for i in range(len(mine))]
