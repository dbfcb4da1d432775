"""Queries over history, carried state, usage, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.presets import CAMERA_POSITION, CAMERA_TARGET, CAMERAS, INITIAL_STATE, LIGHTS, SPEEDS, SURFACES, TEMPLATE_KIND, TEMPLATE_PALETTE, ZOOM_OFFSETS
from wordloom.operators import history as H
from wordloom.operators import ordered as O
from wordloom.operators import state as ST
from wordloom.operators import terms as TE
from wordloom.session import fresh_path
from wordloom.sources import history as SH
from wordloom.streaming import growth as GR
from wordloom.streaming import prompts as SP
from wordloom.streaming import runs as R

from .base import (
    HISTORY_SQL, PV, USAGE_SQL, caps, centroid_sql, history, pool_vectors, prices, prompt_columns, query, r6, rounded, state_sql, table, usage, user_prompts, vector_count,
)
from .prompts import COMBOS
from .words import FNV, TERMS

# ---- history ---------------------------------------------------------------------------------------


@query("seen_hashes", f"WITH {HISTORY_SQL} SELECT DISTINCT hash FROM hist")
def seen_hashes(spark, sf):
    return H.seen_hashes(history(spark, sf))


@query(
    "history_summary",
    f"""WITH {HISTORY_SQL} SELECT count(*) AS total, count(*) FILTER (favorited) AS favorites, count(DISTINCT template_id) AS templates_used,
    min(created_at) AS first_generated, max(created_at) AS last_generated FROM hist""",
)
def history_summary(spark, sf):
    return H.summary(history(spark, sf))


@query("history_by_template", f'WITH {HISTORY_SQL} SELECT template_id, count(*) AS "count" FROM hist GROUP BY 1')
def history_by_template(spark, sf):
    return H.by_template(history(spark, sf))


@query("recent_prompts", f"WITH {HISTORY_SQL} SELECT id, hash, template_id FROM hist ORDER BY id DESC LIMIT 50")
def recent_prompts(spark, sf):
    return H.recent(history(spark, sf)).select("id", "hash", "template_id")


@query("favorite_prompts", f"WITH {HISTORY_SQL} SELECT id, hash, template_id FROM hist WHERE favorited")
def favorite_prompts(spark, sf):
    return H.favorites(history(spark, sf)).select("id", "hash", "template_id")


@query("favorite_hashes", f"WITH {HISTORY_SQL} SELECT hash FROM hist WHERE favorited")
def favorite_hashes(spark, sf):
    return H.favorite_hashes(history(spark, sf))


FIRSTS = f"{HISTORY_SQL}, firsts AS (SELECT hash, min(id) AS id FROM hist GROUP BY 1)"


@query("first_writes", f"WITH {FIRSTS} SELECT hist.hash, hist.id, template_id FROM hist JOIN firsts ON hist.id = firsts.id")
def first_writes(spark, sf):
    return SH.first_writes(history(spark, sf)).select("hash", "id", "template_id")


@query("appended_history", f"WITH {FIRSTS} SELECT hist.hash, hist.id, template_id, favorited FROM hist JOIN firsts ON hist.id = firsts.id")
def appended_history(spark, sf):
    """Two batches, each appended twice: first write wins, replays add nothing."""
    path = fresh_path(spark, "history")
    h = history(spark, sf)
    half = int(h.agg(F.max("id")).first()[0]) // 2
    for part in (h.filter(F.col("id") <= half), h.filter(F.col("id") > half)) * 2:
        SH.append_new(part, path)
    return SH.read_history(spark, path).select("hash", "id", "template_id", "favorited")


@query("history_round_trip", f"WITH {HISTORY_SQL} SELECT id, hash, favorited, created_at, 'k' AS slot, template_id AS word FROM hist")
def history_round_trip(spark, sf):
    """Rows encoded to text columns, written, read and decoded."""
    path = fresh_path(spark, "rows")
    h = history(spark, sf).withColumn("components", F.create_map(F.lit("k"), F.array("template_id")))
    SH.encode(h).write.parquet(path)
    d = SH.decode(spark.read.parquet(path))
    return d.select("id", "hash", "favorited", F.col("created_at").cast("timestamp").alias("created_at"), F.map_keys("components")[0].alias("slot"), F.col("components")["k"][0].alias("word"))


@query("exported_favorites", f"WITH {HISTORY_SQL} SELECT id, hash, template_id, favorited FROM hist WHERE favorited")
def exported_favorites(spark, sf):
    path = fresh_path(spark, "export")
    SH.export_json(history(spark, sf), path, favorites_only=True)
    return spark.read.schema("id bigint, hash string, template_id string, favorited boolean").json(path)


@query(
    "coverage",
    f"""WITH {COMBOS}, {HISTORY_SQL}, c AS (SELECT count(DISTINCT hash) AS n, (SELECT sum(permutations)::DOUBLE FROM combo) AS t FROM hist)
SELECT n AS "count", round(n / t * 100, 9) AS percent, round(least(log10(n + 1) / log10(t), 1.0), 6) AS progress, floor(32 * least(log10(n + 1) / log10(t), 1.0))::INTEGER AS cells FROM c""",
)
def coverage(spark, sf):
    from wordloom.operators.templates import parse_slots, total_combinations

    from .base import components, part_templates

    total = total_combinations(parse_slots(part_templates(spark, sf)), components(spark, sf)).first()["permutations"]
    c = H.coverage(history(spark, sf), int(total))
    return c.select("count", F.round("percent", 9).alias("percent"), r6("progress").alias("progress"), "cells")


@query(
    "milestones",
    f"""WITH {FIRSTS}, r AS (SELECT hist.id, hist.hash, template_id, row_number() OVER (ORDER BY hist.id) AS c FROM hist JOIN firsts ON hist.id = firsts.id)
SELECT c AS "count", id, hash, template_id FROM r WHERE c IN (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)""",
)
def milestones(spark, sf):
    return H.milestones(history(spark, sf))


@query(
    "template_switches",
    f"WITH {HISTORY_SQL} SELECT id, template_id, template_id IS DISTINCT FROM lag(template_id) OVER (ORDER BY id) AS template_changed FROM hist",
)
def template_switches(spark, sf):
    return H.template_switches(history(spark, sf))


@query(
    "toggled_favorites",
    f"""WITH {HISTORY_SQL}, t AS (SELECT hash, count(*) % 2 = 1 AS flip FROM hist WHERE template_id IN ('click', 'view') GROUP BY 1)
SELECT id, hash.hash AS hash, favorited <> coalesce(flip, false) AS favorited FROM hist hash LEFT JOIN t ON hash.hash = t.hash""",
)
def toggled_favorites(spark, sf):
    h = history(spark, sf)
    return H.apply_toggles(h, h.filter(F.col("template_id").isin("click", "view"))).select("id", "hash", "favorited")


@query(
    "favorite_marks",
    f"WITH {HISTORY_SQL} SELECT id, hash, hash IN (SELECT hash FROM hist WHERE favorited) AS is_favorite FROM hist",
)
def favorite_marks(spark, sf):
    h = history(spark, sf)
    return H.with_favorites(h, H.favorite_hashes(h)).select("id", "hash", "is_favorite")


@query(
    "unseen_prompts",
    f"WITH {HISTORY_SQL} SELECT id, hash FROM hist WHERE hash NOT IN (SELECT hash FROM hist WHERE template_id = 'purchase')",
)
def unseen_prompts(spark, sf):
    h = history(spark, sf)
    return SH.unseen(h, h.filter("template_id = 'purchase'")).select("id", "hash")


@query(
    "user_sequence",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
    round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS spent FROM events""",
)
def user_sequence(spark, sf):
    """Dense numbering and running totals per user, in chunks that split heavy users."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    chunk = 2500
    e = O.dense_index(e, ["user_id"], "event_id", "place", chunk)
    e = O.running_sum(e, ["user_id"], "event_id", {"spent": "value"}, chunk_rows=chunk)
    return e.select("event_id", "user_id", "place", (F.round("spent", 4) + F.lit(0.0)).alias("spent"))


# ---- carried state ---------------------------------------------------------------------------------

CATS = list(INITIAL_STATE)
STATE = state_sql(INITIAL_STATE)


def _state_text(df):
    return df.select("user_id", "id", *[F.concat_ws("|", F.col("state")[c]).alias(c) for c in CATS])


STATE_SELECT = f"WITH {STATE} SELECT user_id, id, {', '.join(f'''array_to_string(s_{c}, '|') AS {c}''' for c in CATS)} FROM st"


@query("carried_state", STATE_SELECT)
def carried_state(spark, sf):
    return _state_text(ST.carry_forward(user_prompts(spark, sf), ["user_id"]))


@query("carried_state_chunked", STATE_SELECT)
def carried_state_chunked(spark, sf):
    """The same in chunks, the form for keys that hold a large share of the rows."""
    return _state_text(ST.carry_forward(user_prompts(spark, sf), ["user_id"], chunk_rows=2500))


@query("carried_state_streamed", STATE_SELECT)
def carried_state_streamed(spark, sf):
    stream = prompt_columns(R.file_stream(spark, sf, "events.parquet"), vector_count(spark, sf))
    return _state_text(R.drain(SP.carried_state(stream, "user_id")))


CHANGED = f"""{STATE}, ch AS (SELECT user_id, id, CASE WHEN words IS DISTINCT FROM coalesce(
    lag(words) OVER (PARTITION BY user_id, category ORDER BY id), CASE category {' '.join(f"WHEN '{c}' THEN ['{v[0]}']" for c, v in INITIAL_STATE.items())} END)
    THEN category END AS changed FROM st)"""


@query("changed_slots", f"WITH {CHANGED} SELECT id, coalesce(changed, '') AS changed FROM ch")
def changed_slots(spark, sf):
    s = ST.carry_forward(user_prompts(spark, sf), ["user_id"])
    return s.select("id", F.concat_ws("|", "changed").alias("changed"))


@query(
    "state_reads",
    f"""WITH {STATE} SELECT id, s_light_behavior[1] AS light, len({' || '.join(f's_{c}' for c in CATS)}) AS n_words, 12 AS n_filled FROM st""",
)
def state_reads(spark, sf):
    s = ST.carry_forward(user_prompts(spark, sf), ["user_id"])
    return s.select("id", ST.slot_word(F.col("state"), "light_behavior").alias("light"), F.size(ST.state_words(F.col("state"))).cast("bigint").alias("n_words"), F.size(ST.filled_categories(F.col("state"))).alias("n_filled"))


def _bucket(word: str, n: int) -> str:
    return f"('0x' || substr(md5({word}), 1, 8))::BIGINT % {n}"


def _pick(values: list, index: str) -> str:
    return f"({values!r})[{index} + 1]"


def _lookup(key: str, values: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default!r} END"


FEATURES = f"""{STATE}, cam AS (SELECT *, {_pick(CAMERAS, _bucket('s_spatial_logic[1]', 8))} AS camera, ({_pick(ZOOM_OFFSETS, _bucket('s_scale_perspective[1]', 8))})::DOUBLE AS zoom FROM st),
pos AS (SELECT *, {', '.join(f"({_lookup('camera', {k: v[i] for k, v in CAMERA_POSITION.items()}, 0.0)})::DOUBLE AS p{i}, ({_lookup('camera', {k: v[i] for k, v in CAMERA_TARGET.items()}, 0.0)})::DOUBLE AS t{i}" for i in range(3))} FROM cam),
len_ AS (SELECT *, sqrt((p0 - t0) ** 2 + (p1 - t1) ** 2 + (p2 - t2) ** 2) AS reach FROM pos)"""


@query(
    "feature_rows",
    f"""WITH {FEATURES} SELECT id, {_lookup('template_id', TEMPLATE_KIND, 'mesh_filled')} AS kind, {_lookup('template_id', TEMPLATE_PALETTE, 'matrix')} AS palette,
    {_pick(LIGHTS, _bucket('s_light_behavior[1]', 8))} AS light, camera, round(p0 + (p0 - t0) / reach * zoom, 6) + 0.0 AS camera_x,
    round(p1 + (p1 - t1) / reach * zoom, 6) + 0.0 AS camera_y, round(p2 + (p2 - t2) / reach * zoom, 6) + 0.0 AS camera_z,
    ({_pick(SPEEDS, _bucket('s_temporal_state[1]', 8))})::DOUBLE AS speed, ({_bucket('s_subject_form[1]', 3)})::INTEGER AS detail,
    {_pick(SURFACES, FNV.format(w='lower(trim(s_material_substance[1]))') + ' % 11')} AS surface FROM len_""",
)
def feature_rows(spark, sf):
    f = ST.feature_rows(ST.carry_forward(user_prompts(spark, sf), ["user_id"]))
    names = ["id", "kind", "palette", "light", "camera", "camera_x", "camera_y", "camera_z", "speed", "detail", "surface"]
    return rounded(f.select(*names), "camera_x", "camera_y", "camera_z")


def _word_vectors(spark, sf):
    return pool_vectors(spark, sf).select(F.col("word").cast("string").alias("word"), "visual")


DYN = f"""{STATE}, {centroid_sql()}, tot AS (SELECT list(x ORDER BY p) AS c, max(k) AS k FROM (SELECT p, sum(x) AS x, count(*) AS k FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS p FROM cen) GROUP BY 1)),
sw AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS category, unnest(s_{c}) AS word FROM st" for c in CATS)}),
fw AS (SELECT sw.id, sw.category, row_number() OVER () AS r, pv.a FROM sw JOIN pv ON sw.word = pv.ordinal::VARCHAR),
pr AS (SELECT x.id, list_dot_product(x.a, y.a) AS s, x.category <> y.category AS crossing FROM fw x JOIN fw y ON x.id = y.id AND x.r < y.r),
ps AS (SELECT id, avg(s) AS m, max(s) FILTER (crossing) AS x FROM pr GROUP BY 1),
mv0 AS (SELECT id, p, avg(x) AS x, FROM (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM fw) GROUP BY ALL),
mv AS (SELECT id, list(x ORDER BY p) AS v FROM mv0 GROUP BY 1), nw AS (SELECT id, count(*) AS n FROM fw GROUP BY 1),
dyn AS (SELECT st.id, coalesce(n, 0)::INTEGER AS n_words, CASE WHEN n >= 2 THEN greatest(0, least(1, 1 - m)) ELSE 0.45 END AS energy,
    CASE WHEN n >= 2 AND x IS NOT NULL THEN greatest(0, least(1, x)) ELSE 0.0 END AS tension,
    CASE WHEN n >= 1 THEN greatest(0, least(1, 1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / k)) ELSE 0.5 END AS void_proximity
    FROM st CROSS JOIN tot LEFT JOIN nw USING (id) LEFT JOIN ps USING (id) LEFT JOIN mv USING (id))"""
DYN_SELECT = f"WITH {DYN} SELECT id, n_words, round(energy, 6) + 0.0 AS energy, round(tension, 6) + 0.0 AS tension, round(void_proximity, 6) + 0.0 AS void_proximity FROM dyn"


@query("prompt_dynamics", DYN_SELECT)
def prompt_dynamics(spark, sf):
    total, n = ST.centroid_total(pool_vectors(spark, sf))
    s = ST.carry_forward(user_prompts(spark, sf), ["user_id"])
    return rounded(ST.dynamics(s, _word_vectors(spark, sf), total, n), "energy", "tension", "void_proximity")


@query("prompt_dynamics_streamed", DYN_SELECT)
def prompt_dynamics_streamed(spark, sf):
    total, n = ST.centroid_total(pool_vectors(spark, sf))
    states = SP.carried_state(prompt_columns(R.file_stream(spark, sf, "events.parquet"), vector_count(spark, sf)), "user_id")
    out = fresh_path(spark, "dynamics")
    SP.dynamics_stream(states, _word_vectors(spark, sf), total, n, out, fresh_path(spark, "progress")).awaitTermination()
    d = spark.read.parquet(out).drop("batch")
    return rounded(d, "energy", "tension", "void_proximity")


@query(
    "gravity_poles",
    f"""WITH {STATE}, {PV}, sw AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS category, unnest(s_{c}) AS word, generate_subscripts(s_{c}, 1) - 1 AS place FROM st" for c in CATS)}),
g AS (SELECT sw.*, a[1] AS x, a[2] AS y, a[3] AS z, sqrt(a[1] ** 2 + a[2] ** 2 + a[3] ** 2) AS n FROM sw JOIN pv ON sw.word = pv.ordinal::VARCHAR)
SELECT id, category, place::INTEGER AS place, word, round(x / n, 6) + 0.0 AS x, round(y / n, 6) + 0.0 AS y, round(z / n, 6) + 0.0 AS z FROM g""",
)
def gravity_poles(spark, sf):
    s = ST.carry_forward(user_prompts(spark, sf), ["user_id"])
    return rounded(ST.gravity_poles(s, _word_vectors(spark, sf)).drop("slot_no"), "x", "y", "z")


@query(
    "conversation_state",
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w, -1)::BIGINT AS last_user,
    coalesce(last_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS) OVER w, -1)::BIGINT AS last_assistant
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def conversation_state(spark, sf):
    """Roles as slots: the latest turn of each role, carried through the conversation."""
    c = table(spark, sf, "conversations")
    p = c.select("conv_id", "turn", F.create_map("role", F.array(F.length("text").cast("string"))).alias("components"))
    s = ST.carry_forward(p, ["conv_id"], "turn", {"user": ["-1"], "assistant": ["-1"]})
    return s.select("conv_id", "turn", *[F.col("state")[r][0].cast("bigint").alias(f"last_{r}") for r in ("user", "assistant")])


# ---- usage -----------------------------------------------------------------------------------------


def _costed(spark, sf):
    return TE.with_cost(usage(spark, sf), prices(spark))


@query("usage_cost", f"WITH {USAGE_SQL} SELECT model, iteration, category, count(*) AS requests, round(sum(cost), 8) + 0.0 AS cost FROM cost GROUP BY ALL")
def usage_cost(spark, sf):
    c = _costed(spark, sf).groupBy("model", "iteration", "category").agg(F.count(F.lit(1)).alias("requests"), F.sum("cost").alias("cost"))
    # the finest price step is 5e-8, so 8 digits hold every sum exactly and leave no rounding ties
    return c.withColumn("cost", F.round("cost", 8) + F.lit(0.0))


@query(
    "usage_totals",
    f"""WITH {USAGE_SQL} SELECT model, count(*) AS requests, sum(input + cache_read + cache_write)::BIGINT AS input_tokens, sum(output)::BIGINT AS output_tokens,
    sum(cache_read + cached)::BIGINT AS cached_tokens, round(sum(cost), 8) + 0.0 AS cost, round(sum(cache_read + cached) / greatest(sum(input + cache_read + cache_write), 1) * 100, 6) + 0.0 AS cache_hit_pct
FROM cost GROUP BY ROLLUP (model)""",
)
def usage_totals(spark, sf):
    t = TE.usage_totals(_costed(spark, sf))
    return t.withColumns({"cost": F.round("cost", 8) + F.lit(0.0), "cache_hit_pct": r6("cache_hit_pct")})


@query(
    "cost_caps",
    f"""WITH {USAGE_SQL}, cap AS (SELECT model, floor(sum(cost) * 40) / 100 AS cap FROM cost GROUP BY 1), it AS (SELECT model, iteration, sum(cost) AS c FROM cost GROUP BY ALL),
run AS (SELECT model, iteration, coalesce(sum(c) OVER (PARTITION BY model ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM it)
SELECT run.model, run.iteration, count(*) AS admitted, round(max(before_), 8) + 0.0 AS spent_before FROM run JOIN cap ON run.model = cap.model AND before_ < cap.cap JOIN cost ON cost.model = run.model AND cost.iteration = run.iteration GROUP BY ALL""",
)
def cost_caps(spark, sf):
    a = TE.within_caps(_costed(spark, sf), caps(spark, sf))
    g = a.groupBy("model", "iteration").agg(F.count(F.lit(1)).alias("admitted"), F.max("spent_before").alias("spent_before"))
    return g.withColumn("spent_before", F.round("spent_before", 8) + F.lit(0.0))


# ---- streams ---------------------------------------------------------------------------------------


def _history_stream(spark, sf):
    e = R.file_stream(spark, sf, "events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.substring(F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", cents)), 1, 16).alias("hash"),
        F.col("event_type").alias("template_id"), F.col("ts").alias("created_at"),
    )


@query("streamed_distinct_prompts", f"WITH {HISTORY_SQL} SELECT DISTINCT hash FROM hist")
def streamed_distinct_prompts(spark, sf):
    return R.drain(SP.distinct_prompts(_history_stream(spark, sf))).select("hash")


@query(
    "streamed_counts",
    f'WITH {HISTORY_SQL} SELECT template_id, count(*) AS "count", min(created_at) AS first_generated, max(created_at) AS last_generated FROM hist GROUP BY 1',
)
def streamed_counts(spark, sf):
    return R.drain(SP.running_counts(_history_stream(spark, sf)), "complete")


@query("streamed_append", f"WITH {FIRSTS} SELECT hash, id FROM firsts")
def streamed_append(spark, sf):
    path = fresh_path(spark, "history")
    SP.append_stream(_history_stream(spark, sf), path, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path).select("hash", "id")


@query("streamed_pool_growth", f"WITH {TERMS} SELECT DISTINCT category, term FROM term")
def streamed_pool_growth(spark, sf):
    docs = R.file_stream(spark, sf, "documents.parquet").select(F.col("lang").alias("category"), "text")
    return R.drain(GR.grow(docs))
