import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import compression, convnet, decontaminate, pii, rules
from wordloom.llm.samples import held_out, labelled

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ---- rules


def measures(t):
    w, n = WORD.findall(t), len(WORD.findall(t))
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    inside = {j for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_brute_force(spark):
    texts = [r.text for r in docs(spark).collect()] + ["", " ", "a", "\n\n", "x y " * 40, "a\nb\na\n \n a\na\x1cb", "*" * 99, "q " * 7, "q " * 8, "q " * 9]
    m = rules.measure_batch(pa.array(texts))
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [measures(t) for t in texts]


def test_ledger_of_odd_rows_and_ablation(odd, none):
    rows = rules.ledger(odd)
    assert rows.count() == odd.count()
    few = rules.mask(("few_words",))
    assert rows.where("n_words = 0").select(F.min("failed"), F.max("failed")).first()[:] == (few, few)
    assert rules.ledger(none).count() == 0 and rules.ablation(rules.ledger(none)).count() == 0
    ledger = rows.select("failed").collect()
    for r in rules.ablation(rows).collect():
        all_, bit = rules.mask(rules.POLICIES[r.policy]), rules.mask((r.rule,))
        f = [x.failed for x in ledger]
        assert r.n_failed == sum(x & bit != 0 for x in f)
        assert r.n_only == sum(x & all_ == bit for x in f)
        assert r.n_kept == sum(x & all_ == 0 for x in f)
        assert r.n_kept_without == sum(x & all_ & ~bit == 0 for x in f)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (
                (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")))
                or (kind == "card" and not (16 <= len(d) <= 19 and luhn(d)))
                or (kind == "phone" and not 8 <= len(d) <= 15)
            ):
                continue
            out.append((kind, m.start(), m.end()))
    return out


HARD = [
    None, "", "a@b.com_x@y.z q@w", "a@b.c.", "x..y@z-.q.com", "1.2.3.4.5.6.7.8", "999.1.1.1 007.0.0.01 1.2.3.0000255", "4111 1111 1111 1111 4111111111111111", "4111 1111-1111 1111",
    "12 34 56 78 90 12 34 56 78 90", "+1 (555) 123-4567 ++33 1 2 +1 2", "😀 a@b.com 😀 +44 20 7946 0958", "tel 555-123-4567, call (020) 7946 0958.", "mail: bob (at) mail (dot) com",
    "a" * 3000 + "@b.com", "a@" * 500 + "b.c", "a@b" + ".c" * 5000, "9" * 5000, "1." * 3000, "1 " * 3000, "+1" + " " * 5000 + "2", "a@b.com " * 300,
]


def test_base_spans_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    real = docs(spark).select("doc_id", "text")
    model = pii.train(real)
    for r in pii.find(rows.union(real), model).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base(r.text or ""), (r.text or "")[:80]
        assert [(s.rank, s.start, s.end) for s in r.spans] == sorted((s.rank, s.start, s.end) for s in r.spans)
    plan = pii.find(real, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_added_spans_lie_apart_from_base_spans(spark):
    texts = [f"phone 0{k}0 555 12{k}4 and mail bob{k}@mail.com or bob{k} (at) mail.com" for k in range(9)] + [f"call +1 555 010 99{k}{k}, host 10.0.0.{k}" for k in range(9)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find(rows, pii.train(rows)).collect()
    for r in got:
        own = [s for s in r.spans if s.base]
        assert not [1 for s in r.spans if not s.base for b in own if b.start < s.end and s.start < b.end]


def test_twenty_thousand_addresses_in_one_text(spark):
    text = " ".join(f"a{k}@b.com" for k in range(20_000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.train(rows.limit(0))
    begun = time.time()
    spans = pii.find(rows, model).first().spans
    assert [text[s.start : s.end] for s in spans] == text.split() and time.time() - begun < 30


def test_a_column_named_like_the_spans(spark):
    rows = spark.createDataFrame([(1, "a@b.com", "x")], "doc_id long, text string, __spans string")
    out = pii.redact(rows, pii.train(rows))
    assert out.columns == rows.columns and tuple(out.first()) == (1, "[EMAIL]", "x")


def test_redaction_and_odd_rows(spark, odd, none):
    model = pii.train(odd)
    assert pii.redact(odd, model).columns == odd.columns
    key = lambda rows: sorted((str(tuple(r)) for r in rows))
    assert key(pii.redact(odd, model).collect()) == key(odd.collect())
    assert pii.redact(none, pii.train(none)).count() == 0
    rows = spark.createDataFrame([(1, "é a@b.com, 1.2.3.4 +1 555 123 4567."), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(rows, model).orderBy("doc_id").collect()] == ["é [EMAIL], [IP] [PHONE].", None]


def test_query_columns(spark):
    from wordloom.llm.queries import QUERIES

    text = {r.doc_id: r.text for r in docs(spark).collect()}
    for r in QUERIES["op2_personal_data"](spark, DATA).collect():
        b = base(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in b).encode()).hexdigest()
        assert {"%s:%d:%d" % x for x in b} <= set(r.spans.split(","))


# ---- decontamination


def distance(pattern, text):
    """The least edit distance of a pattern to a part of a text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(t, n, rng):
    t = list(t)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + rng.choice((0, 1))] = rng.choice(("", "q", "zz"[:1]))
    return "".join(t)


def test_leaks_equal_brute_force():
    rng = random.Random(5)
    items = ["".join(rng.choice("abcd ef") for _ in range(rng.randint(25, 70))) for _ in range(12)]
    items = [decontaminate.normal(t) for t in items]
    work = decontaminate.Items(list(range(12)), items, 0.1)
    work.build()
    for _ in range(60):
        k = rng.randrange(12)
        text = decontaminate.normal("x" * rng.randint(0, 9) + edited(items[k], rng.randint(0, 8), rng) + " tail " + edited(items[(k + 1) % 12], rng.randint(0, 8), rng))
        got = {i: (d, a, b) for i, d, a, b in work.leaks(text)}
        for i, t in enumerate(items):
            d = distance(t, text)
            assert (i in got) == (d <= int(0.1 * len(t))), (t, text)
            if i in got:
                assert got[i][0] == d
                assert distance(text[got[i][1] : got[i][2]], t) <= d


def test_leaks_in_tables(spark, odd, none):
    item = "The quick brown fox jumps over the lazy dog near the bank"
    bench = spark.createDataFrame([(1, item), (1, item), (None, "another item of more than twenty letters"), (3, None), (4, "short"), (5, "")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"say {item.upper()} now", 0), (2, "clean", 0), (None, "Another  item of\nmore than twenty letters", 0), (1, f"say {item.upper()} now", 0), (4, None, 0), (5, "word " * 30_000 + item, 0)], "doc_id long, text string, leaks int")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.pairs(rows, bench).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 0), (None, None, 0), (5, 1, 0)], key=str)
    assert sorted(r.doc_id for r in decontaminate.clean(rows, bench).collect()) == [2, 4]
    assert decontaminate.clean(rows, bench).columns == rows.columns
    assert decontaminate.clean(rows, bench.limit(0)).count() == rows.count()
    assert decontaminate.pairs(rows, bench.where("item_id = 4")).count() == 0
    assert decontaminate.pairs(none, bench).count() == 0 and decontaminate.clean(odd, bench).count() == odd.count()


def test_short_items_stand_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "Forty-two"), (2, "no"), (3, "\u65e5\u672c")], "item_id long, text string")
    texts = ["it is forty-two.", "forty-twos", "known", "No!", "\u4eca\u65e5\u672c\u5f53", "xno no", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.pairs(rows, bench).collect()}
    assert got == {(0, 1), (3, 2), (4, 3), (5, 2)}
    assert decontaminate.clean(rows, bench).count() == 7 and decontaminate.clean(rows, bench, least=2).count() == 3


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number {k} has letters enough {k * 7919}") for k in range(40)], "item_id long, text string")
    rows = spark.createDataFrame([(k, f"x item number {k} has letters enough {k * 7919} y") for k in range(40)], "doc_id long, text string")
    whole = decontaminate.pairs(rows, bench, rate=0.0).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(decontaminate.pairs(rows, bench, rate=0.0).collect()) == sorted(whole)
    assert {(r.doc_id, r.item_id) for r in whole} >= {(k, k) for k in range(40)}


# ---- classifiers


def area(scores, labels):
    rank = np.argsort(np.argsort(scores))
    y = np.array(labels) == 1
    return (rank[y].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize("module, label, held, least", [(compression, "toxic", (4, 2), 0.85), (convnet, "quality", (5, 0), 0.9)])
def test_held_out_documents_are_told_apart(spark, module, label, held, least):
    sf = "/root/testdata/sf0.1"
    all_, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.train(all_, labels, per_class=500, label=label)
    rest = all_.join(labels.where(held_out(F.col("doc_id"), *held)).select("doc_id", label), "doc_id")
    rows = module.score(rest.select("doc_id", "text"), model).join(labels, "doc_id").select("score", label).collect()
    assert area([r[0] for r in rows], [r[1] for r in rows]) > least


def test_samples_are_bounded_and_leave_held_out_rows(spark):
    all_ = docs(spark)
    labels = all_.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("y")).union(spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, y int"))
    rows = labelled(all_, labels, "y", ~held_out(F.col("doc_id"), 4, 2), 20)
    whole = {r.text for r in all_.collect()}
    assert len(rows) == 40 and sum(y for _, y in rows) == 20 and {t for t, _ in rows} <= whole
    assert rows == labelled(all_, labels, "y", ~held_out(F.col("doc_id"), 4, 2), 20)
    often = spark.createDataFrame([(1, f"text {k}") for k in range(500)], "doc_id long, text string")
    assert len(labelled(often, labels.where("doc_id = 1 OR doc_id = 3"), "y", F.lit(True), 20)) == 20


@pytest.mark.parametrize("module", [compression, convnet])
def test_scores_of_odd_rows(odd, none, module):
    for rows in ([], [("a b c", 1)], [("some words here", 0), ("other words there", 1)] * 10):
        model = module.fit(rows)
        got = module.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert module.score(none, model).count() == 0


def test_gradients_of_the_net():
    rng = np.random.default_rng(0)
    rows = [("aXb" * 200, 1), ("cd" * 30, 0)]
    net = convnet.fit(rows, epochs=0)
    net = convnet.Net(*[p.astype(np.float64) for p in net.parts()])
    net.vectors[: convnet.PAD] += rng.normal(0, 0.1, (convnet.PAD, convnet.SIZE))
    net.bias[:] += rng.normal(0, 0.1, convnet.FILTERS)  # away from the threshold, which has no gradient
    data, y = [t.encode() for t, _ in rows], np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(convnet.scores(net, data)) + (1 - y) * np.log(1 - convnet.scores(net, data)))
    for part, g in zip(net.parts(), convnet._gradients(net, data, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = part[at]
        part[at] = was + 1e-5
        up = loss()
        part[at] = was - 1e-5
        down = loss()
        part[at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_savings_follow_the_toxic_content():
    rows = [(f"plain words number {k} and more of them", 0) for k in range(60)] + [(f"plain words gribbleflax number {k}", 1) for k in range(60)]
    random.Random(1).shuffle(rows)
    model = compression.fit(rows)
    s = compression.Scorer(model.ordinary, model.toxic)
    assert b"gribbleflax" in model.toxic and s.savings("you gribbleflax you").max() >= compression.SAVED > s.savings("some plain words").max()
    assert list(s.savings("")) == []
