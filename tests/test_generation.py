import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import generation as G
from wordloom.operators import templates as T
from wordloom.plans import batch as B
from wordloom.sources.history import read_history

WORDS = {"material": ["glass", "rust", "wax", "moiré \"x\""], "light_behavior": ["dim", "harsh"], "solo": ["one"]}


@pytest.fixture(scope="module")
def comps(spark):
    rows, at = [], 0
    for c, ws in WORDS.items():
        for w in ws:
            rows.append((c, at, w, {"dim": "bright", "harsh": ""}.get(w)))
            at += 1
    return spark.createDataFrame(rows, "category string, ordinal bigint, word string, opposite string")


def templates(spark, **structures):
    return spark.createDataFrame([(k, v, [], "") for k, v in structures.items()], "id string, structure string, required_components array<string>, notes string")


def test_slot_forms(spark):
    t = templates(spark, t="{c} {c:2} {c:2:,} {c:2:} {c::-} {c:1} {x_9:10: and } {} {bad name}")
    got = [(r["category"], r["count"], r["separator"]) for r in T.parse_slots(t).orderBy("slot_no").collect()]
    assert got == [("c", 1, " "), ("c", 2, " "), ("c", 2, ","), ("c", 2, ""), ("c", 1, ":-"), ("c", 1, " "), ("x_9", 10, " and ")]


def test_combinations(spark, comps):
    t = templates(spark, a="{material:2} {solo}", b="{material} {material} {nothing}", c="{solo:3}")
    got = {r["template_id"]: (int(r["permutations"]), int(r["hash_distinct"])) for r in T.combinations(T.parse_slots(t), comps).collect()}
    assert got == {"a": (12, 6), "b": (12, 6), "c": (1, 1)}


def test_big_products_are_exact(spark):
    pool = spark.range(0, 1000).select(F.lit("c").alias("category"))
    t = templates(spark, t="{c:9}")
    want = 1
    for i in range(9):
        want *= 1000 - i
    assert int(T.combinations(T.parse_slots(t), pool).first()["permutations"]) == want


def expected_hash(row):
    canon = json.dumps({"t": row["template_id"], "c": {k: sorted(v) for k, v in row["components"].items()}}, sort_keys=True)
    return hashlib.sha256(canon.encode()).hexdigest()[:16]


@pytest.mark.parametrize("limit", [G.LITERAL_WORDS, 0])
def test_every_draw_once(spark, comps, limit):
    """All ranks of a small space give all ordered draws, each once, with the right text and hash."""
    t = templates(spark, t="{material:2:+} by {light_behavior} of {material}, it's {none}")
    rows = G.generate(t, comps, 1000, literal_words=limit).collect()
    assert len(rows) == 4 * 3 * 2 * 2 == len({r["positive"] for r in rows})
    for r in rows:
        m, light = r["components"]["material"], r["components"]["light_behavior"]
        assert r["positive"] == f"{m[0]}+{m[1]} by {light[0]} of {m[2]}, it's [missing none]"
        assert len(set(m)) == 3 and r["hash"] == expected_hash(r)
        tail = "low quality, blurry, text, watermark"
        assert r["negative"] == (f"bright, {tail}" if light == ["dim"] else tail)
    assert len({r["hash"] for r in rows}) == 4 * 2


def test_both_paths_agree(spark, comps):
    t = templates(spark, a="{material} {solo:2}", b="plain text", c="{light_behavior:2}")
    one, two = (sorted(map(str, G.generate(t, comps, 5, literal_words=n).collect())) for n in (G.LITERAL_WORDS, 0))
    assert one == two and any("plain text" in r for r in one)


def test_exhausted_categories(spark, comps):
    t = templates(spark, t="{solo} {solo} {gone}")
    assert G.generate(t, comps, 9).first()["positive"] == "one [missing solo] [missing gone]"
    assert G.generate(t, comps, 9, reuse=True, leave_missing=True).first()["positive"] == "one one {gone}"


def test_filters_stay_above_the_digits(spark, comps):
    t = templates(spark, t="{material} {light_behavior} {material} {solo} {material}")
    df = G.generate(t, comps, 5)
    plan = df.filter(F.col("hash") > "8")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == df._jdf.queryExecution().optimizedPlan().toString().count("md5")


@pytest.mark.parametrize("limit", [G.LITERAL_WORDS, 0])
def test_unique(spark, comps, limit):
    t = templates(spark, t="{material:2} {light_behavior}")  # 24 draws, 12 hashes
    first = G.generate_unique(t, comps, 7, literal_words=limit)
    hashes = {r["hash"] for r in first.collect()}
    assert len(hashes) == first.count() == 7
    rest = G.generate_unique(t, comps, 50, first, literal_words=limit).collect()
    assert len(rest) == 5 and not hashes & {r["hash"] for r in rest}
    assert G.generate_unique(t, comps, 3, first.unionByName(G.generate(t, comps, 24)), literal_words=limit).count() == 0


def test_rounds_move_keys_and_draw_no_more_than_needed(spark, comps, tmp_path, monkeypatch):
    t, path = templates(spark, t="{material:2} {light_behavior}", u="{material} {light_behavior} {material}"), str(tmp_path / "h")
    drawn, held = [], []
    generate, cut = G.generate, G.cut
    monkeypatch.setattr(G, "generate", lambda t, c, n, *a, **kw: drawn.append(n) or generate(t, c, n, *a, **kw))
    monkeypatch.setattr(G, "cut", lambda df: held.append(df.columns) or cut(df))
    B.run_batch(t, comps, 2, path)
    drawn.clear()
    rows = B.run_batch(t, comps, 2, path)
    assert {r["id"] for r in rows.collect()} == {3, 4}
    # the first ranks are known: as many again are drawn, not eight times as many
    assert max(drawn) <= 2 and held and not any("positive" in c or "components" in c for c in held)


def test_batch_appends_to_history(spark, comps, tmp_path):
    t, path = templates(spark, t="{material:2} {light_behavior}", u="{material} {solo}"), str(tmp_path / "h")
    B.run_batch(t, comps, 6, path)
    one = read_history(spark, path)
    assert one.count() == 6
    B.run_batch(t, comps, 4, path, one)
    two = read_history(spark, path)
    assert two.count() == 10 == two.select("hash").distinct().count() == two.select("id").distinct().count()
    stats = B.statistics(path, t, comps)
    assert stats["summary"].first()["total"] == 10 and stats["coverage"].first()["count"] == 10
    B.emit(two, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 10


def test_sampled_words(spark, comps):
    got = G.sample_words(comps, spark.range(50).withColumnRenamed("id", "key"), 3)
    sizes = {(r["key"], r["category"]): (r["count"], r["d"]) for r in got.groupBy("key", "category").agg(F.count("*").alias("count"), F.count_distinct("word").alias("d")).collect()}
    assert len(sizes) == 150 and all(c == d == min(3, len(WORDS[k[1]])) for k, (c, d) in sizes.items())


def test_artifacts_depend_on_the_hash_only(spark):
    df = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("hash"))
    assert 10 < G.flag_artifacts(df).filter("is_artifact").count() < 90


# Words per category and the categories of the slots of each template.
POOL_SIZES = {
    "atmosphere_field": 62, "color_logic": 62, "light_behavior": 64, "material_substance": 65, "medium_render": 59, "phenomenon_pattern": 62,
    "scale_perspective": 64, "setting_location": 59, "spatial_logic": 64, "subject_form": 58, "temporal_state": 62, "texture_density": 60,
}
SLOTS = {
    "material_study": "subject_form material_substance texture_density light_behavior color_logic medium_render",
    "environmental": "scale_perspective setting_location atmosphere_field subject_form light_behavior medium_render",
    "process_state": "temporal_state subject_form phenomenon_pattern material_substance color_logic medium_render",
    "specimen": "scale_perspective material_substance subject_form medium_render color_logic",
    "abstract_field": "phenomenon_pattern spatial_logic color_logic atmosphere_field medium_render",
    "liminal": "setting_location light_behavior atmosphere_field spatial_logic color_logic medium_render",
    "textural_macro": "scale_perspective texture_density material_substance light_behavior color_logic medium_render",
    "ruin_state": "temporal_state setting_location atmosphere_field phenomenon_pattern color_logic medium_render",
    "minimal_object": "material_substance subject_form spatial_logic light_behavior color_logic medium_render",
    "material_collision": "material_substance material_substance phenomenon_pattern texture_density light_behavior color_logic medium_render",
    "atmospheric_depth": "subject_form atmosphere_field atmosphere_field light_behavior scale_perspective color_logic medium_render",
    "temporal_diptych": "temporal_state temporal_state subject_form spatial_logic material_substance color_logic medium_render",
    "essence": "texture_density subject_form spatial_logic",
    "site_decay": "scale_perspective temporal_state setting_location phenomenon_pattern texture_density",
}


def test_size_of_the_known_space(spark):
    comp = spark.createDataFrame([(c,) for c, n in POOL_SIZES.items() for _ in range(n)], "category string")
    t = templates(spark, **{k: " ".join("{" + c + "}" for c in v.split()) for k, v in SLOTS.items()})
    assert int(T.total_combinations(T.parse_slots(t), comp).first()["permutations"]) == 10_628_638_727_072
