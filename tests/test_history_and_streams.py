import pytest
from pyspark.sql import functions as F

from wordloom.functions.presets import INITIAL_STATE
from wordloom.operators import history as H
from wordloom.operators import ordered as O
from wordloom.operators import state as ST
from wordloom.operators import terms as TE
from wordloom.session import fresh_path
from wordloom.sources import history as SH
from wordloom.sources import pools as P
from wordloom.sources import vectors as SV
from wordloom.streaming import growth as GR
from wordloom.streaming import prompts as SP
from wordloom.streaming import runs as R

PROMPT = "user string, id bigint, hash string, template_id string, components map<string,array<string>>, created_at timestamp"


@pytest.fixture(scope="module")
def prompts(spark):
    """A key with most of the rows, repeated hashes, missing categories."""
    rows = []
    cats = list(INITIAL_STATE)
    for i in range(300):
        user = "hot" if i % 3 else f"u{i % 5}"
        comps = {cats[i % 12]: [f"w{i % 7}"], cats[(i * 5) % 12]: [f"x{i % 3}", "y"]}
        rows.append((user, i, f"h{(i * 7) % 180}", f"t{(i // 4) % 3}", comps))
    df = spark.createDataFrame(rows, "user string, id bigint, hash string, template_id string, components map<string,array<string>>")
    return df.withColumn("created_at", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)).cache()


def text(x):
    return str(sorted(x.items())) if isinstance(x, dict) else str(x)


def as_rows(df, *cols):
    return sorted(tuple(text(x) for x in r) for r in df.select(*cols).collect())


def replay(prompts):
    """The plain sequential rule."""
    states, out = {}, []
    for r in sorted(prompts.collect(), key=lambda r: r["id"]):
        s = states.setdefault(r["user"], {k: list(v) for k, v in INITIAL_STATE.items()})
        changed = sorted(c for c, w in r["components"].items() if s[c] != w)
        s.update({c: r["components"][c] for c in changed})
        out.append((text(r["id"]), text(dict(s)), text(changed)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1_000_000, 17])
def test_carry_forward(prompts, chunk):
    got = ST.carry_forward(prompts, ["user"], chunk_rows=chunk)
    assert as_rows(got, "id", "state", "changed") == replay(prompts)


def write_batches(spark, prompts, parts):
    """One file per micro-batch; files are read in the order of their times."""
    import os
    import time

    folder = fresh_path(spark, "in")
    step = 300 // parts
    for i in range(parts):
        part = prompts.filter(F.col("id").between(i * step, (i + 1) * step - 1)).orderBy(F.desc("id")).coalesce(1)
        part.write.mode("append").parquet(folder)
        now = time.time() - 100 + 10 * i
        new = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        for f in new:
            p = os.path.join(folder, f)
            if os.path.getmtime(p) > time.time() - 5:
                os.utime(p, (now, now))
    return R.file_stream(spark, folder, files_per_trigger=1)


def test_streamed_state_equals_batch(spark, prompts):
    out = R.drain(SP.carried_state(write_batches(spark, prompts, 3), "user"))
    assert as_rows(out, "id", "state", "changed") == replay(prompts)
    first = out.filter("template_changed").groupBy("user").agg(F.min("id").alias("i")).count()
    assert first == prompts.select("user").distinct().count()


def test_streamed_dedup_counts_and_append(spark, prompts):
    stream = write_batches(spark, prompts, 3)
    hashes = prompts.select("hash").distinct().count()
    assert R.drain(SP.distinct_prompts(stream)).count() == hashes
    assert R.drain(SP.distinct_prompts(stream, "created_at", "1 hour")).count() >= hashes
    counts = R.drain(SP.running_counts(stream), "complete")
    assert as_rows(counts, "template_id", "count") == as_rows(prompts.groupBy("template_id").count(), "template_id", "count")
    path = fresh_path(spark, "hist")
    for _ in range(2):  # the second run starts over and must add nothing
        SP.append_stream(stream, path, fresh_path(spark, "mark")).awaitTermination()
    want = prompts.groupBy("hash").agg(F.min("id").alias("id"))
    assert as_rows(spark.read.parquet(path), "hash", "id") == as_rows(want, "hash", "id")


def test_streamed_dynamics_equal_batch(spark, prompts):
    vec = spark.createDataFrame([(f"w{i}", [1.0, float(i), -1.0, 0.5]) for i in range(7)] + [("y", [0.2, 0.1, 3.0, 1.0])], "word string, visual array<double>")
    from wordloom.functions.vectors import unit

    vec = vec.select("word", unit(F.col("visual")).alias("visual"))
    total = [0.3, 0.1, -0.2, 0.9]
    out = fresh_path(spark, "dyn")
    states = SP.carried_state(write_batches(spark, prompts, 2), "user")
    SP.dynamics_stream(states, vec, total, 2, out, fresh_path(spark, "mark")).awaitTermination()
    batch = ST.dynamics(ST.carry_forward(prompts, ["user"]), vec, total, 2)
    cols = ["id", "n_words", *[F.round(c, 9) for c in ("energy", "tension", "void_proximity")]]
    assert as_rows(spark.read.parquet(out), *cols) == as_rows(batch, *cols)


def test_dynamics_defaults(spark):
    s = spark.createDataFrame([(1, {"a": ["none"]}), (2, {"a": ["p"]}), (3, {"a": ["p", "q"]}), (4, {"a": ["p"], "b": ["q", "p"]})], "id bigint, state map<string,array<string>>")
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.6, 0.8])], "word string, visual array<double>")
    got = {r["id"]: (r["n_words"], round(r["energy"], 6), round(r["tension"], 6), round(r["void_proximity"], 6)) for r in ST.dynamics(s, v, [1.0, 0.0], 1).collect()}
    assert got[1] == (0, 0.45, 0.0, 0.5)
    assert got[2] == (1, 0.45, 0.0, 0.0)
    assert got[3][:3] == (2, 0.4, 0.0)
    assert got[4][:3] == (3, round(1 - (0.6 + 1 + 0.6) / 3, 6), 1.0)
    assert ST.dynamics(s, v, None, 0).filter("void_proximity <> 0.5").count() == 0


@pytest.mark.parametrize("chunk", [1_000_000, 23])
def test_ordered_scans(prompts, chunk):
    by = {}
    for r in sorted(prompts.collect(), key=lambda r: r["id"]):
        by.setdefault(r["user"], []).append(r["id"])
    got = O.dense_index(prompts.select("user", "id"), ["user"], "id", "n", chunk)
    got = O.running_sum(got, ["user"], "id", {"total": "id"}, chunk_rows=chunk)
    got = O.running_sum(got, ["user"], "id", {"prior": "id"}, inclusive=False, chunk_rows=chunk)
    want = sorted((u, i, n + 1, sum(ids[: n + 1]), sum(ids[:n])) for u, ids in by.items() for n, i in enumerate(ids))
    assert sorted(tuple(r) for r in got.collect()) == want
    switches = H.template_switches(prompts, chunk).orderBy("id").collect()
    kinds = [r["template_id"] for r in switches]
    assert [r["template_changed"] for r in switches] == [True] + [a != b for a, b in zip(kinds, kinds[1:])]
    marks = H.milestones(prompts, chunk).orderBy("count").collect()
    seen, want = set(), []
    for r in sorted(prompts.collect(), key=lambda r: r["id"]):
        if r["hash"] not in seen:
            seen.add(r["hash"])
            if len(seen) in (10, 25, 50, 100):
                want.append((len(seen), r["id"]))
    assert [(r["count"], r["id"]) for r in marks] == want


def test_old_history_without_favorites(spark, tmp_path):
    p = str(tmp_path / "old")
    spark.createDataFrame([("a", 1)], "hash string, id bigint").write.parquet(p)
    assert SH.read_history(spark, p).first()["favorited"] is False


def test_toggles(spark):
    h = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "hash string, favorited boolean")
    t = spark.createDataFrame([("a",), ("b",), ("a",), ("a",), ("zzz",)], "hash string")
    assert as_rows(H.apply_toggles(h, t), "hash", "favorited") == [("a", "True"), ("b", "False"), ("c", "False")]


def test_yaml_pools_and_templates(spark, tmp_path):
    (tmp_path / "one.yaml").write_text("components:\n  a:\n  - word: x\n    opposite: y\n  - word: z\n  empty: []\n  b: [p, 'q r']\n")
    (tmp_path / "two.yaml").write_text("a: [x]\nb:\n- word: w\n  opposite: null\n")
    got = P.read_pools(spark, [str(tmp_path / "one.yaml"), str(tmp_path / "two.yaml")])
    assert as_rows(got, "pool", "category", "ordinal", "word", "opposite") == sorted(
        [("one", "a", "0", "x", "y"), ("one", "a", "1", "z", "None"), ("one", "b", "2", "p", "None"), ("one", "b", "3", "q r", "None"), ("two", "a", "0", "x", "None"), ("two", "b", "1", "w", "None")]
    )
    (tmp_path / "t.yaml").write_text("templates:\n- id: m\n  structure: '{a} of {b:2}'\n  required_components: [a, b]\n")
    t = P.read_templates(spark, str(tmp_path / "t.yaml")).first()
    assert (t["id"], t["required_components"], t["notes"]) == ("m", ["a", "b"], "")
    with pytest.raises(ValueError):
        P.only(got, "category", ["nowhere"])


def test_archive_keys(spark):
    rows = [("_metadata", [1.0], 0), ("c/a/b/clip", [1.0], 1), ("c/a/b/t5", [2.0], 2), ("d/w/clip", [3.0], 3), ("e/w/clip", [4.0], 4), ("f/w/clip", [], 5), ("bad", [9.0], 6)]
    e = spark.createDataFrame(rows, "key string, vector array<double>, ordinal bigint")
    got = as_rows(SV.by_category(e.filter("ordinal < 5")), "category", "word", "visual", "semantic")
    assert got == [("c", "a/b", "[1.0]", "[2.0]"), ("d", "w", "[3.0]", "None"), ("e", "w", "[4.0]", "None")]
    assert as_rows(SV.word_vectors(e), "word", "vector") == [("a/b", "[1.0]"), ("w", "[4.0]")]
    s = spark.createDataFrame([("clip/a/b", [1.0], 0), ("t5/a/b", [2.0], 1)], "key string, vector array<double>, ordinal bigint")
    assert as_rows(SV.by_space(s), "word", "visual", "semantic") == [("a/b", "[1.0]", "[2.0]")]
    with pytest.raises(KeyError):
        SV.attach(spark.createDataFrame([("zz",)], "word string"), SV.word_vectors(e), strict=True)
    old = spark.createDataFrame([("w", [0.0])], "word string, vector array<double>")
    assert as_rows(SV.extend(old, SV.word_vectors(e)), "word", "vector") == [("a/b", "[1.0]"), ("w", "[0.0]")]


def test_usage_formulas(spark):
    usage = spark.createDataFrame(
        [("s", 1, 1000000, 10, 5, 7, 9, None), ("d", 1, 100, 10, 300, 0, 0, None), ("f", 1, 1000000, 1000000, 0, 0, 0, None), ("f", 2, 5, 5, 0, 0, 0, 0.25), ("f", 3, 5, 5, 0, 0, 0, 1.0)],
        "model string, iteration bigint, input bigint, output bigint, cached bigint, cache_write bigint, cache_read bigint, reported_cost double",
    )
    prices = spark.createDataFrame([("s", "split_cache", 3.0, 15.0, 3.75, 0.3, None), ("d", "cached_discount", 2.5, 15.0, None, None, 0.25), ("f", "flat", 0.4, 2.0, None, None, None)],
                                   "model string, scheme string, input double, output double, cache_write double, cache_read double, cached_input double")
    c = TE.with_cost(usage, prices)
    got = {(r["model"], r["iteration"]): r["cost"] for r in c.collect()}
    assert got[("s", 1)] == pytest.approx(3.0 + (7 * 3.75 + 9 * 0.3 + 10 * 15) / 1e6)
    assert got[("d", 1)] == pytest.approx((0 * 2.5 + 300 * 0.25 + 10 * 15) / 1e6)
    assert (got[("f", 1)], got[("f", 2)]) == (pytest.approx(2.4), 0.25)
    caps = spark.createDataFrame([("f", 2.5), ("s", 0.0)], "model string, cap double")
    kept = as_rows(TE.within_caps(c, caps), "model", "iteration")
    assert kept == [("d", "1"), ("f", "1"), ("f", "2")]
    total = {r["model"]: r for r in TE.usage_totals(c).collect()}
    assert total[None]["requests"] == 5 and total["s"]["cached_tokens"] == 14


def test_pool_growth_stream(spark):
    folder = fresh_path(spark, "lines")
    for part in (["1. Oak\n2. oak\n- Pine"], ["pine\nElm", "elm"]):
        spark.createDataFrame([("wood", x) for x in part], "category string, text string").coalesce(1).write.mode("append").parquet(folder)
    got = R.drain(GR.grow(R.file_stream(spark, folder, files_per_trigger=1)))
    assert as_rows(got, "category", "term") == [("wood", "elm"), ("wood", "oak"), ("wood", "pine")]


def test_words_of_states_are_not_sent_to_all_tasks(spark):
    """A plan guesses few words where maps are exploded; only vectors that are measured to be small are broadcast."""
    states = spark.range(1).selectExpr("id", "map('color_logic', array('7', '8', 'none')) AS state")
    vectors = spark.range(3000).selectExpr("cast(id as string) AS word", "array(3D, 0D, 4D + id) AS visual")
    for frame in (ST.gravity_poles(states, vectors), ST.dynamics(states, vectors, None, 0)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and "BuildRight" in plan
    assert sorted(r.word for r in ST.gravity_poles(states, vectors).collect()) == ["7", "8"]


def test_prices_do_not_gather_all_requests_of_a_model(spark):
    """A few prices or admissions go to the requests, not the requests of a model to one task."""
    usage = spark.range(400).selectExpr(
        "'m' AS model", "id % 4 AS iteration", "id AS input", "1L AS output", "0L AS cached", "0L AS cache_write", "0L AS cache_read", "cast(null AS double) AS reported_cost"
    )
    prices = spark.createDataFrame([("m", "flat", 1.0, 1.0, None, None, None)], "model string, scheme string, input double, output double, cache_write double, cache_read double, cached_input double")
    costed = TE.with_cost(usage, prices)
    caps = spark.createDataFrame([("m", 0.03)], "model string, cap double")
    for frame in (costed, TE.within_caps(costed, caps)):
        assert "Exchange hashpartitioning" not in frame._jdf.queryExecution().executedPlan().toString()
    assert costed.filter("cost > 0").count() == 400 and TE.within_caps(costed, caps).count() == 200
