"""What is returned is what is stored; encoders, caches and archives."""

import hashlib

import numpy as np
import pytest
from helpers import unit_rows, vector_frame

from wordloom.functions.encoders import ngram_encoder, register
from wordloom.operators import diversity as D
from wordloom.operators import generation as G
from wordloom.operators import moments as M
from wordloom.plans import batch as B
from wordloom.session import fresh_path
from wordloom.sources import vectors as SV


@pytest.fixture(scope="module")
def space(spark):
    t = spark.createDataFrame([("t1", "{a} by {b:2}")], "id string, structure string")
    rows = [("a", i, f"a{i}") for i in range(6)] + [("b", i, f"b{i}") for i in range(5)]
    return t, spark.createDataFrame(rows, "category string, ordinal bigint, word string")


def plain_encoder(texts, dim, n, salt):
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        p = f" {text} "
        for i in range(len(p) - n + 1):
            h = hashlib.md5((salt + p[i : i + n]).encode()).hexdigest()
            row[int(h[:8], 16) % dim] += 1 if int(h[8], 16) < 8 else -1
        size = np.linalg.norm(row)
        if size:
            row /= size
        else:
            row[0] = 1
    return out


@pytest.mark.parametrize("dim, n, salt", [(64, 3, "v:"), (96, 4, "s:"), (5, 6, "")])
def test_encoder_equals_the_plain_loop(dim, n, salt):
    texts = ["fog", "", "a", "dust motes", "fog", "é日本🎉", "x" * 300, "\n"]
    assert np.allclose(ngram_encoder(dim, n, salt)(texts), plain_encoder(texts, dim, n, salt))
    assert np.allclose(ngram_encoder(dim, n, salt)(["", ""]), plain_encoder(["", ""], dim, n, salt))


def test_cache_encodes_a_word_once(spark):
    path = fresh_path(spark, "cache")
    words = spark.createDataFrame([("fog",), ("rain",), ("fog",), (None,)], "word string")
    first = SV.embed_once(words, path, {"visual": "visual"})
    assert first.count() == 4 and first.filter("visual is null").count() == 1
    register("broken", lambda: (lambda texts: (_ for _ in ()).throw(ValueError(str(texts))) if any(texts) else np.zeros((len(texts), 2))))
    again = SV.embed_once(words, path, {"visual": "broken"})
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert spark.read.parquet(path).count() == 2


def test_archive_metadata(spark, pool):
    df, _ = pool
    meta = SV.write_archive(df, fresh_path(spark, "archive"), {"visual": "m1", "semantic": "m2"})
    assert {(r.space, r.model, r.dimension, r.words, r.total) for r in meta.collect()} == {("visual", "m1", 6, 72, 72), ("semantic", "m2", 5, 72, 72)}
    assert meta.filter("written_at is null").count() == 0


def test_batches_return_what_they_store(spark, space):
    t, comps = space
    path = fresh_path(spark, "history")
    calls = [B.run_batch(t, comps, 20, path) for _ in range(2)]
    got = [tuple(r) for c in calls for r in c.select("id", "hash", "created_at").collect()]
    stored = [tuple(r) for r in spark.read.parquet(path).select("id", "hash", "created_at").collect()]
    assert sorted(got) == sorted(stored) and sorted(r[0] for r in got) == list(range(1, 41)) and len({r[1] for r in got}) == 40


def test_a_space_that_is_nearly_used_up(spark, space):
    t, comps = space
    every = G.generate_unique(t, comps, 10_000)
    n = every.count()
    assert n == 6 * 10  # the two draws of one slot give the same prompt in either order
    old = every.limit(n - 3)
    assert G.generate_unique(t, comps, 3, old).count() == 3
    assert G.generate_unique(t, comps, 4, old).count() == 3
    with pytest.raises(ValueError, match="3 of 4"):
        G.generate_unique(t, comps, 4, old, strict=True)


def test_any_number_of_models(spark, pool):
    df, arrays = pool
    rows = D.models_as_rows(df, {"a": "visual", "b": "semantic", "c": "visual"})
    got = {(r.model, r.category): r for r in D.by_model(rows, 0.3).collect()}
    assert len(got) == 9
    for c, (_, v, s) in arrays.items():
        for m, x in (("a", v), ("b", s), ("c", v)):
            sims = (x @ x.T)[np.triu_indices(len(x), 1)]
            assert abs(got[m, c].mean - sims.mean()) < 1e-4 and got[m, c].redundant_pairs == (sims > 0.3).sum()


def test_sums_of_many_partitions(spark, monkeypatch):
    v = unit_rows(120, 4, 8)
    df = vector_frame(spark, [("ab"[i % 2], i, f"w{i}", v[i], v[i]) for i in range(120)]).repartition(60)
    whole = [{r.category: r for r in f.collect()} for f in (M.vector_sums(df, ["category"]), M.pair_sums(df, ["category"]))]
    monkeypatch.setattr(M, "MERGE_AT_ONCE", 4)
    steps = [{r.category: r for r in f.collect()} for f in (M.vector_sums(df, ["category"]), M.pair_sums(df, ["category"]))]
    for a, b in zip(whole, steps, strict=True):
        for c in "ab":
            assert np.allclose(np.hstack([np.ravel(x) for x in a[c][1:]]), np.hstack([np.ravel(x) for x in b[c][1:]]))
    assert whole[1]["a"].pairs == 60 * 59 // 2
