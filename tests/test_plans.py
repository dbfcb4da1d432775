import numpy as np
import pytest
from helpers import vector_frame
from pyspark.sql import functions as F

from wordloom.functions.encoders import embed_models, embed_text, ngram_encoder, pool_tokens, register
from wordloom.operators import probes as PB
from wordloom.plans import analyze_pools as AP
from wordloom.plans import profile as PF
from wordloom.sources import pools as P
from wordloom.sources import reports
from wordloom.sources import vectors as SV


def test_set_report(spark, tmp_path):
    rows = [("p", "a", 0, "x"), ("p", "b", 1, "x"), ("p", "a", 2, "y"), ("q", "a", 0, "x"), ("q", "a", 1, "z"), ("r", "c", 0, "w")]
    comp = spark.createDataFrame(rows, "pool string, category string, ordinal bigint, word string")
    rep = AP.set_report(comp, ["p", "q", "r"])
    overlap = {(r["pool_a"], r["pool_b"]): (r["shared"], r["only_a"], r["only_b"], r["jaccard"]) for r in rep["overlap"].collect()}
    assert overlap == {("p", "q"): (1, 1, 1, 0.3333), ("p", "r"): (0, 2, 1, 0.0), ("q", "r"): (0, 2, 1, 0.0)}
    assert [tuple(r)[2:] for r in rep["agreement"].collect()] == [(1, 0, 1)]  # the last category of x in p is b
    assert rep["consensus"].count() == 0
    assert {r["word"] for r in rep["unique"].collect()} == {"y", "z", "w"}
    total = rep["sizes"].filter("category = 'TOTAL'").first()
    assert (total["p"], total["q"], total["r"]) == (3, 2, 1)
    reports.write_report(rep, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "overlap")).count() == 3


def test_vector_reports(pool):
    df, arrays = pool
    two = df.withColumn("pool", F.lit("p")).unionByName(df.withColumn("pool", F.lit("q")))
    rep = AP.confidence_report(two, ["p", "q"])
    sizes = {c: len(a[0]) for c, a in arrays.items()}
    assert {(r["pool"], r["category"]): r["count"] for r in rep["categories"].collect()} == {(p, c): n for p in "pq" for c, n in sizes.items()}
    assert all(r["p"] == r["q"] for name in ("visual_by_pool", "semantic_by_pool", "quadrants_by_pool") for r in rep[name].collect())
    assert sum(r["pct"] for r in rep["quadrants"].filter("pool = 'p'").collect()) == pytest.approx(100, abs=0.3)
    flags = rep["flag_counts"].filter("pool = 'p'").first()
    assert flags["both_disagree"] + flags["visual_only"] + flags["semantic_only"] == rep["flagged"].filter("pool = 'p'").count()
    gaps = AP.gap_report(df)
    assert gaps["centroids"].count() == 9 and gaps["closest"].count() == gaps["most_distant"].count() == 3
    model = AP.model_report(df, {"m1": "visual", "m2": "semantic"})
    assert model["pivot"].columns == ["category", "m1", "m2"] and model["stats"].count() == 6
    assert AP.space_report(df, 0.5)["visual_closer"].count() == 5
    assert AP.diversity_report(df)["diversity"].count() == 3


def test_vector_tables(spark, pool, tmp_path):
    df, _ = pool
    path = str(tmp_path / "v")
    SV.write_vectors(df, path)
    back = SV.read_vectors(spark, path)
    assert back.count() == df.count()
    meta = {r["category"]: (r["words"], r["visual_dim"], r["semantic_dim"]) for r in SV.archive_summary(back).collect()}
    assert meta == {"a": (40, 6, 5), "b": (25, 6, 5), "c": (7, 6, 5)}
    chosen = df.filter("ordinal < 3").select("category", F.col("ordinal").cast("int").alias("rank"), "word")
    pairs = spark.createDataFrame([("a", "a0", "a2")], "category string, word string, opposite string")
    assert [r["opposite"] for r in P.selected_pool(chosen, pairs).orderBy("rank").collect()] == ["a2", None, None]


def test_encoders(spark):
    texts = ["oak", "", None, "Moiré interference"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r for r in embed_text(df, "t", {"v": "visual", "w": lambda: ngram_encoder(8)}, batch=2).collect()}
    assert got[2]["v"] is None and got[2]["w"] is None
    want = ngram_encoder(64, 3, "v:")(["oak", "", "Moiré interference"])
    for i, row in zip((0, 1, 3), want):
        np.testing.assert_allclose(got[i]["v"], row, atol=1e-12)
        assert np.linalg.norm(got[i]["v"]) == pytest.approx(1)

    def lengths():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    register("lengths", lengths)
    long = embed_models(df.filter("t is not null"), "t", ["lengths", "visual"])
    assert long.count() == 6
    oak = long.filter("id = 0 and model = 'lengths'").first()["vector"]
    np.testing.assert_allclose(oak, np.array([3, 1]) / np.sqrt(10))


def test_token_pooling(spark):
    rows = [("d", 1, [3.0, 0.0]), ("d", 1, [0.0, 1.0]), ("d", 0, [50.0, 50.0]), ("none", 0, [1.0, 1.0])]
    got = {r["doc"]: r["vector"] for r in pool_tokens(spark.createDataFrame(rows, "doc string, mask int, vector array<double>"), ["doc"]).collect()}
    np.testing.assert_allclose(got["d"], np.array([3, 1]) / np.sqrt(10))
    assert got["none"] == [0.0, 0.0]


def test_probes(spark, pool):
    df, arrays = pool
    base = df.select("ordinal", "word", F.col("visual").alias("vector"))
    v = np.concatenate([a[1] for a in arrays.values()])
    probes = {r["id"]: np.array(r["vector"]) for r in PB.random_probes(spark, 200, 6).collect()}
    assert all(abs(np.linalg.norm(p) - 1) < 1e-9 for p in probes.values())
    near = {i: 1 - (p @ v.T).max() for i, p in probes.items()}
    want = sorted(near, key=lambda i: (-near[i], i))[:5]
    assert {r["id"] for r in PB.find_voids(base, 6, 5, 200).collect()} == set(want)
    rounds = [max(r["distance"] for r in PB.find_voids_iterative(base, 6, 4, 80, rounds=n).collect()) for n in (1, 3)]
    assert rounds[1] >= rounds[0]
    deep = PB.find_voids_iterative(base, 6, 4, 80, rounds=3).collect()
    assert len({r["id"] for r in deep}) == 4
    for r in deep:
        assert r["distance"] == pytest.approx(1 - (np.array(r["vector"]) @ v.T).max(), abs=1e-9)
    cloud = PB.jitter(base.select(F.col("ordinal").alias("id"), "vector"), n_per_scale=3)
    assert cloud.count() == len(v) * 5 * 3
    spread = {r["scale"]: r["d"] for r in cloud.join(base.select(F.col("ordinal").alias("id"), F.col("vector").alias("c")), "id").groupBy("scale").agg(
        F.avg(F.expr("aggregate(zip_with(vector, c, (x, y) -> x * y), 0D, (s, x) -> s + x)")).alias("d")).collect()}
    assert spread[0.01] > spread[0.1] > spread[0.4]
    line = PB.interpolation(spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "id int, a array<double>, b array<double>"), 3).orderBy("step").collect()
    np.testing.assert_allclose([r["vector"] for r in line], [[1, 0], [0.5**0.5, 0.5**0.5], [0, 1]], atol=1e-12)


def test_profiles(spark):
    comp = spark.createDataFrame([(c, i * 100 + j, f"{c} {w}") for i, c in enumerate("ab") for j, w in enumerate(["oak", "iron", "salt", "fog"])], "category string, ordinal bigint, word string")
    t = spark.createDataFrame([("t1", "{a} and {b}", ["a", "b"], ""), ("t2", "{a:2}", ["a"], ""), ("t3", "fixed text", [], "")], "id string, structure string, required_components array<string>, notes string")
    vec = PF.sample_vectors(t, comp, 10).cache()
    rows = vec.collect()
    groups = {k: np.array([r["visual"] for r in rows if r["template_id"] == k]) for k in ("t1", "t2", "t3")}
    sizes = {k: len(g) for k, g in groups.items()}
    assert sizes == {"t1": 10, "t2": 10, "t3": 1}
    cross = {r["template_id"]: r["visual_cross_mean"] for r in PF.cross_means(vec).collect()}
    m = {(r["a"], r["b"]): r["visual_mean"] for r in PF.template_matrix(vec).collect()}
    for k, g in groups.items():
        others = np.concatenate([o for n, o in groups.items() if n != k])
        assert cross[k] == pytest.approx((g @ others.T).mean(), abs=1e-9)
        for n, o in groups.items():
            i, j = np.triu_indices(len(g), 1)
            assert m[k, n] == pytest.approx((g @ o.T).mean() if n != k else ((g @ g.T)[i, j].mean() if len(g) > 1 else 0.0), abs=1e-9)
    p = {r["template_id"]: r for r in PF.rank_profiles(PF.profile_templates(t, comp, 10)).collect()}
    assert sorted(r["rank"] for r in p.values()) == [1, 2, 3] and int(p["t2"]["theoretical_combinations"]) == 12
    assert p["t1"]["combined_score"] == pytest.approx((p["t1"]["internal_score"] + p["t1"]["uniqueness_score"]) / 2)
    base = PF.profile_templates(t.filter("id <> 't2'"), comp, 10)
    delta = {r["template_id"]: r["delta_combined_score"] for r in PF.against_baseline(PF.profile_templates(t, comp, 10), base).collect()}
    assert delta["t2"] is None and delta["t1"] is not None
    d = {r["template_id"]: r["count"] for r in PF.prompt_diversity(vec).collect()}
    assert d == {**sizes, None: 21}
