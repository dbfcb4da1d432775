import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from wordloom.llm import bpe, compression, decontaminate, forest
from wordloom.llm.common import components

DATA = "/root/testdata/sf0.001"


def sets(texts, k):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def groups(ids, found):
    """The component of each id by comparing all pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            c = len(found[a] & found[b])
            if c and 100 * c >= 80 * (len(found[a]) + len(found[b]) - c):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


def check(spark, rows, k):
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    ids, found = [i for i, _ in rows], sets([t for _, t in rows], k)
    want = groups(ids, found)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in zip(ids, found, strict=True)}


def test_groups_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_groups_of_copies_near_the_threshold(spark):
    rng, rows, at = random.Random(2), [], 100
    for _ in range(25):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 9))):
                v[rng.randrange(len(v))] = f"x{rng.randrange(99)}"
            rows.append((at, " ".join(v)))
            at += 1
    rows += [(1, "Same Text"), (2, "same\ttext"), (3, "same"), (4, "same"), (5, ""), (6, None), (7, ""), (8, "a b"), (9, "b a")]
    rng.shuffle(rows)
    check(spark, rows, 2)


def test_odd_rows_and_an_empty_table(odd, none):
    got = forest.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    tied = [r for r in got if r.component_id is not None and r.n_shingles == 1]
    assert tied and all(r.kept == (r.doc_id == r.component_id) or r.doc_id is None for r in got)
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert forest.near_duplicates(none).count() == 0


def test_shingles_at_batch_borders():
    texts = ["a b c", "", "a b", "c", "C a", "x " * 5]
    one = [set(s.tolist()) for s in forest.shingles(pa.array(texts), 2)]
    alone = [set(forest.shingles(pa.array([t]), 2)[0].tolist()) for t in texts]
    assert one == alone and [len(s) for s in one] == [2, 0, 1, 1, 1, 1]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, *range(200, 260)]}, 5: 5, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:889], rng.integers(0, 2**63, 111, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        same = (forest.signature(np.unique(a)) == forest.signature(np.unique(b))).mean()
    assert abs(same - 0.8) < 0.12


def test_pipeline_equals_brute_force(spark):
    """Every stage against a plain version over what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.drop_toxic(spark, docs, DATA)
    model = compression.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    s, w = compression.Scorer(model.ordinary, model.toxic), np.array(model.weights)
    score = lambda t: compression.sigmoid(np.array(s.features(t)) @ w[:-1] + w[-1])
    want = {i: r for i, r in rows.items() if score(r.text) < compression.CUT}
    assert {r.doc_id for r in first.collect()} == set(want)
    second = corpus_pipeline.drop_near_copies(spark, first, DATA)
    ids = sorted(want)
    of = groups(ids, sets([want[i].text for i in ids], 5))
    want = {i: want[i] for i in ids if of[i] == i}
    assert {r.doc_id for r in second.collect()} == set(want)
    third = corpus_pipeline.drop_leaks(spark, second, DATA)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    third_rows = third.collect()
    exact = {i for i, r in want.items() if any(t in decontaminate.normal(r.text) for t in items)}
    assert not exact & {r.doc_id for r in third_rows} and exact
    assert len(want) - len(exact) - len(third_rows) <= 1
    fourth = corpus_pipeline.mask_personal_data(spark, third, DATA)
    masked = {r.doc_id: r.text for r in fourth.collect()}
    assert set(masked) == {r.doc_id for r in third_rows}
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]", t) for t in masked.values())
    last = corpus_pipeline.encode(spark, fourth, DATA).collect()
    v = bpe.Vocabulary.load(bpe.VOCABULARY)
    assert {r.doc_id: v.decode(r.ids).decode() for r in last} == masked
    assert all(x.columns == docs.columns for x in (first, second, third, fourth))


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "id", "kept", "score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() >= 1, name
        assert stage(spark, none.select("doc_id", "text", "id", "kept", "score"), DATA).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
    assert collections.Counter(corpus_pipeline.run(spark, DATA).dtypes) == collections.Counter([("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids", "array<int>")])


def test_links_among_many_texts_of_one_template(spark):
    """Thousands of texts under the threshold to one another, some with a partner just above it."""
    rng, k, rows, at = np.random.default_rng(4), 5, [], 0
    template = [f"t{i}" for i in range(300)]

    def filled(words, places, tag):
        out = list(words)
        for p in places:
            out[p] = f"{tag}v{p}"
        return out

    for m in range(3000):
        text = filled(template, range(100, 100 + int(rng.integers(31, 37))), f"m{m}")
        rows.append((at, " ".join(text)))
        at += 1
        if m % 60 == 0:
            place = int(rng.integers(160, 260))
            rows.append((at, " ".join(filled(text, range(place, place + int(rng.integers(20, 28))), f"p{m}"))))
            at += 1
    ids = [i for i, _ in rows]
    found = [set(s.tolist()) for s in forest.shingles(pa.array([t for _, t in rows]), k)]
    several = sorted(h for h, n in collections.Counter(h for s in found for h in s).items() if n > 1)
    codes = {h: n for n, h in enumerate(several)}
    dense = np.zeros((len(rows), len(codes)), np.float32)
    for r, s in enumerate(found):
        dense[r, [codes[h] for h in s if h in codes]] = 1
    common, size = dense @ dense.T, np.array([len(s) for s in found])
    linked = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    parent = {i: i for i in ids}
    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = sorted((parent[ids[a]], parent[ids[b]]))
        parent = {i: x if r == y else r for i, r in parent.items()}
    pairs = [common[a, b] / (size[a] + size[b] - common[a, b]) for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True)]
    assert len(pairs) == 50 and 0.8 <= min(pairs) and max(pairs) < 0.86
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {r.doc_id: r.component_id for r in got} == parent


def test_one_row_of_each_group(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "A b c", "x"), (None, "a b c", "x"), (None, "d e", "x"), (None, "D e", "x"), (None, "", "x"), (3, "f g", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in out.collect())
    assert got == {(1, "a b c"): 1, (None, "d e"): 1, (None, ""): 1, (3, "f g"): 1}


def test_forest_counts_shared_shingles_in_little_memory():
    """A batch of two million prefix shingles is counted a stretch at a time, and all of them are counted."""
    rng = np.random.default_rng(3)
    n, size = 5000, 400
    columns = [pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.full(n, size))]
    columns += [pa.array([rng.integers(0, 1 << 63, size, dtype=np.uint64).tobytes() for _ in range(n)], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["node", "component", "n_shingles", "prefix"])
    with np.errstate(over="ignore"):
        expected = len(forest._flat(batch, 80)[0])
    tracemalloc.start()
    total = sum(x[3:].sum() > 0 and x.shape[1] for b in forest._tallied(iter([batch]), 80, 7) for x in (np.frombuffer(y, np.int64).reshape(5, -1) for y in b.column(1).to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == expected
    assert peak < 80 << 20


def test_words_are_told_apart_by_byte():
    rng = random.Random(11)
    texts = ["".join(rng.choices("aAbB \t\n\x0b\x1cé漢.", k=rng.randrange(60))) for _ in range(500)]
    texts += ["", " ", "x" * 128, "x" * 129 + " " + "x" * 129, "y" * 300, "z" * 8, "z" * 9, "end", "start"]
    with np.errstate(over="ignore"):
        h, doc = forest._words(pa.array(["before", *texts]).slice(1))
    words = [(w, i) for i, t in enumerate(texts) for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    assert doc.tolist() == [i for _, i in words]
    known = {}
    assert all(known.setdefault(w, x) == x for (w, _), x in zip(words, h.tolist(), strict=True)) and len({*known.values()}) == len(known)


def test_similar_sets_have_a_token_in_common():
    rng = np.random.default_rng(12)
    level = lambda s: (s % np.uint64(211)).astype(np.int32)

    def tokens(s):
        b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([len(s)]), pa.array([forest._prefix(s, level(s), 80)], pa.binary())], ["node", "component", "n", "prefix"])
        token, _, _, short, probes = forest._flat(b, 80)
        return {*token[short].tolist()}, {*token[probes].tolist()}

    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    seen = 0
    with np.errstate(over="ignore"):
        for _ in range(400):
            a = np.unique(draw(int(rng.choice([rng.integers(1, 60), rng.integers(300, 1200), rng.integers(500, 5000)]))))
            out, more = (int(len(a) * x) for x in rng.uniform(0, 0.21, 2))
            b = np.unique(np.append(rng.permutation(a)[out:], draw(more)))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                small, large = sorted((a, b), key=len)
                seen += 1
                assert tokens(small)[0] & tokens(large)[1] or len(a) == len(b) and tokens(large)[0] & tokens(small)[1]
    assert seen > 100


def test_large_sets_of_one_vocabulary_seldom_meet(spark):
    """Pairs of long texts share rare shingles by chance; before, nearly all of these 3,160 pairs were compared."""
    rng = np.random.default_rng(13)
    vocabulary = np.unique(rng.integers(0, 2**63, 60_000).astype(np.uint64))
    rows, none = [], np.zeros(2000, np.int32)
    with np.errstate(over="ignore"):
        for i in range(80):
            s = np.sort(rng.choice(vocabulary, 2000, replace=False))
            rows.append((i, i, 2000, bytearray(forest._prefix(s, none, 80)), bytearray(forest.fold(forest.parity(s), forest.FOLDED).tobytes())))
    prefixes = spark.createDataFrame(rows, "node long, component long, n_shingles long, prefix binary, parity binary")
    assert forest._meetings(prefixes, forest._shared(prefixes, 80, 4, 4), 80, 4).count() < 1000
