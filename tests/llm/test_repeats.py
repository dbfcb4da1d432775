import collections
import hashlib
import random
import re

import numpy as np
import pytest

from wordloom.llm import repeats


def brute(texts, window):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), sorted(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, window):
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long, key string").repartition(3)
    got = {r.row: r for r in repeats.repeats(df, window, carry=["row"]).collect()}
    assert len(got) == len(rows)
    for k, (n, gone, kept) in enumerate(brute([t for _, t in rows], window)):
        r = got[k]
        assert r.doc_id == rows[k][0] and (r.n_words, r.n_removed) == (n, len(gone)), k
        assert [i for s in r.spans for i in range(s.start, s.end)] == gone
        assert (r.kept == kept) if gone else r.kept is None
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("window", [1, 3, 7, 8, 9, 35])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(12 if window < 9 else 5000)}"
    passages = [[word() for _ in range(rng.randint(window, 4 * window))] for _ in range(12)]
    rows = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 3 * window))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randrange(len(p))
            b = rng.randint(a, len(p))
            at = rng.randint(0, len(w))
            w[at:at] = p[a:b] if rng.random() < 0.6 else p
        rows.append((k if k % 7 else None, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [rows[3], rows[3], rows[10], (5, None), (6, ""), (7, " \n "), (8, "a " * (3 * window)), (9, "a b " * (2 * window)), (10, "a b c " * window + "a")]
    check(spark, rows, window)


def test_one_passage_in_a_third_of_all_texts_and_a_long_text(spark):
    rng = random.Random(5)
    hot = [f"h{k}" for k in range(120)]
    rows = []
    for k in range(900):
        w = [f"u{k}-{j}" for j in range(rng.randint(5, 40))]
        if k % 3 == 0:
            a, b = rng.randint(0, 40), rng.randint(80, 120)
            w[3:3] = hot[a:b]
        rows.append((k, " ".join(w)))
    rows.append((2000, " ".join(f"v{k % 9001}" for k in range(20000))))
    rows += [(3000 + k, "same text " * 30) for k in range(300)]
    check(spark, rows, 35)


def test_odd_rows_and_an_empty_table(spark, odd, none):
    got = repeats.repeats(odd, carry=["row", "kept"][:1]).collect()
    assert len(got) == odd.count()
    long = [r for r in got if r.n_words == 20_000]
    assert all(r.n_removed == 20_000 and r.kept == "" for r in long) and long
    assert repeats.repeats(none).count() == 0
    assert repeats.repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_words == 0


def test_pieces_that_share_a_hash_only_are_counted_anew(spark, monkeypatch):
    """With hashes of two bits' worth most edges collide; the digests of their words still tell them apart."""
    whole = repeats.rolled
    monkeypatch.setattr(repeats, "rolled", lambda h, k: whole(h, k) & np.uint64(255) if k == 12 else whole(h, k))
    rng = random.Random(3)
    passages = [[f"p{rng.randrange(300)}" for _ in range(20)] for _ in range(6)]
    rows = [(k, " ".join([f"u{k}-{j}" for j in range(9)] + rng.choice(passages) + ["end", *rng.choice(passages)[4:]])) for k in range(40)]
    check(spark, rows, 12)


def test_least_takes_the_first_of_equal_values():
    g = np.array([3, 1, 1, 5, 0, 0, 9, 1], np.uint64)
    for w in range(1, 9):
        assert repeats.least(g, w).tolist() == [int(np.argmin(g[i : i + w])) + i for i in range(len(g) - w + 1)]
    assert not len(repeats.least(g, 9)) and not len(repeats.rolled(g, 9))
