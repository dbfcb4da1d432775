import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions import hashing as H
from wordloom.functions import labels as L
from wordloom.functions import text as X
from wordloom.functions import vectors as V


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def fnv(word):
    h = 2166136261
    for ch in word:
        h = ((h ^ ord(ch)) * 16777619) % (1 << 32)
    return h


def test_hash_buckets(spark):
    import hashlib

    words = ["glass", "é moiré", "日本", "", "a😀b", "dust motes"]
    got = values(spark, [(w,) for w in words], "w string", H.fnv1a(F.col("w")), H.md5_bucket(F.col("w"), 8), H.md5_uniform(F.col("w")))
    for w, (f, m, u) in zip(words, got):
        assert f == fnv(w)
        assert m == int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
        assert 0 <= u < 1


def test_term_lines(spark):
    text = '\n'.join(['1. "Foo bar"', "- x", "two words here now five six", "y" * 70, "  * Rusty Nail  ", "", "• 'moiré'", "12.5 mm lens"])
    assert values(spark, [(text,)], "t string", X.term_lines(F.col("t"))) == [(["foo bar", "rusty nail", "moiré", "mm lens"],)]


def test_vocabulary_token(spark):
    tokens = ["<pad>", "ab", "▁ab", "abc", "▁a", "▁glass", "naïve", "x▁y", "▁<s>"]
    got = [r[0] for r in values(spark, [(t,) for t in tokens], "t string", X.vocabulary_token(F.col("t")))]
    assert got == [None, None, "ab", "abc", None, "glass", None, "x y", None]


@pytest.mark.parametrize("text,word,starts", [("aaaa", "aa", [0, 2]), ("a.b.c", ".", [1, 3]), ("x\\Ey\\Ez", "\\E", [1, 4]), ("none", "zz", []), ("edge ed", "ed", [0, 5]), ("abc", "", [])])
def test_occurrences(spark, text, word, starts):
    assert values(spark, [(text, word)], "t string, w string", X.occurrences(F.col("t"), F.col("w"))) == [(starts,)]


def test_json_text(spark):
    words = ['plain', 'moiré "x"', "back\\slash", "tab\t"]
    assert [r[0] for r in values(spark, [(w,) for w in words], "w string", X.json_text(F.col("w")))] == [json.dumps(w) for w in words]


def test_vectors(spark):
    got = values(spark, [([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>", V.unit(F.col("a")), V.unit(F.col("z")), V.dot(F.col("a"), F.col("a")), V.pole(F.col("a")))
    assert got == [([0.6, 0.8], [0.0, 0.0], 25.0, [0.6, 0.8])]
    sims = values(spark, [(0.2, 0.6), (0.2, None)], "v double, s double", V.joint(F.col("v"), F.col("s"), 0.25), V.either_similar(F.col("v"), F.col("s")), V.either_distinct(F.col("v"), F.col("s")))
    assert [tuple(round(x, 9) for x in r) for r in sims] == [(0.5, 0.6, 0.2), (0.2, 0.2, 0.2)]


def test_labels(spark):
    got = values(spark, [(-0.006,), (-0.005,), (0.006,)], "d double", L.verdict(F.col("d")))
    assert [g[0] for g in got] == ["better", "same", "worse"]
    got = values(spark, [(0, 100), (99, 100), (1000, 100), (5, 1)], "n int, t int", L.log_progress(F.col("n"), F.col("t")), L.coverage_percent(F.col("n"), F.col("t")))
    assert got == [(0.0, 0.0), (1.0, 99.0), (1.0, 1000.0), (0.0, 500.0)]
    quad = L.quadrant(*[F.col(c) for c in ("c", "ov", "bv", "sv", "os", "bs", "ss")])
    rows = [("a", 0.9, 1.0, "b", 0.9, 1.0, "b"), ("a", 0.85, 1.0, "b", 0.9, 1.0, "a"), ("a", 0.1, 1.0, "a", 0.1, 1.0, "b"), ("a", 0.1, 1.0, "b", 0.1, 1.0, "b")]
    got = values(spark, rows, "c string, ov double, bv double, sv string, os double, bs double, ss string", quad)
    assert [g[0] for g in got] == ["rock_solid", "semantic_anchor", "visual_anchor", "weak"]
