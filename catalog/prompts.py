"""Queries over templates and generated prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import generation as G
from wordloom.operators import state as ST
from wordloom.operators import templates as T
from wordloom.plans import batch as B
from wordloom.plans import profile as PF
from wordloom.session import fresh_path
from wordloom.sources.history import append_new, read_history

from .base import COMPONENTS_SQL, PART_TEMPLATES_SQL, TYPE_CATEGORY, components, part_templates, query, r6, rounded, table, type_templates
from .words import encoder_sql

# ---- templates -------------------------------------------------------------------------------------


@query("slot_parse", f'WITH {PART_TEMPLATES_SQL} SELECT template_id, slot_no::INTEGER AS slot_no, category, "count", separator, slot FROM slots')
def slot_parse(spark, sf):
    return T.parse_slots(part_templates(spark, sf))


@query(
    "template_literals",
    f"""WITH {PART_TEMPLATES_SQL} SELECT id AS template_id, array_to_string(regexp_split_to_array(structure, '\\{{\\w+(?::\\d+)?(?::[^}}]*)?\\}}'), '|') AS pieces FROM tem""",
)
def template_literals(spark, sf):
    return T.literals(part_templates(spark, sf)).select("template_id", F.concat_ws("|", "pieces").alias("pieces"))


@query("template_needs", f'WITH {PART_TEMPLATES_SQL} SELECT template_id, category, sum("count")::BIGINT AS need FROM slots GROUP BY ALL')
def template_needs(spark, sf):
    return T.template_needs(T.parse_slots(part_templates(spark, sf)))


COMBOS = f"""{PART_TEMPLATES_SQL}, {COMPONENTS_SQL}, size AS (SELECT category, count(*) AS n FROM comp GROUP BY 1),
need AS (SELECT template_id, slots.category, sum("count")::BIGINT AS k, coalesce(max(n), 0) AS n FROM slots LEFT JOIN size USING (category) GROUP BY ALL),
f AS (SELECT template_id, category, list_reduce(list_prepend(1::HUGEINT, list_transform(range(0, k), lambda i: greatest(n - i, 1)::HUGEINT)), lambda a, b: a * b) AS perm,
    list_reduce(list_prepend(1::HUGEINT, list_transform(range(0, least(k, n)), lambda i: greatest(n - i, 1)::HUGEINT)), lambda a, b: a * b)
    // list_reduce(list_prepend(1::HUGEINT, list_transform(range(0, least(k, n)), lambda i: (i + 1)::HUGEINT)), lambda a, b: a * b) AS comb FROM need),
combo AS (SELECT template_id, list_reduce(list(perm), lambda a, b: a * b) AS permutations, list_reduce(list(comb), lambda a, b: a * b) AS hash_distinct FROM f GROUP BY 1)"""


@query("combinations", f"WITH {COMBOS} SELECT template_id, permutations::BIGINT AS permutations, hash_distinct::BIGINT AS hash_distinct FROM combo")
def combinations(spark, sf):
    c = T.combinations(T.parse_slots(part_templates(spark, sf)), components(spark, sf))
    return c.select("template_id", F.col("permutations").cast("bigint").alias("permutations"), F.col("hash_distinct").cast("bigint").alias("hash_distinct"))


@query("total_combinations", f"WITH {COMBOS} SELECT sum(permutations)::BIGINT AS permutations, sum(hash_distinct)::BIGINT AS hash_distinct FROM combo")
def total_combinations(spark, sf):
    c = T.total_combinations(T.parse_slots(part_templates(spark, sf)), components(spark, sf))
    return c.select(F.col("permutations").cast("bigint").alias("permutations"), F.col("hash_distinct").cast("bigint").alias("hash_distinct"))


@query(
    "structure_features",
    f"""WITH {PART_TEMPLATES_SQL}, need AS (SELECT template_id, category, sum("count") AS k FROM slots GROUP BY ALL), m AS (SELECT template_id, count(*) FILTER (k > 1) AS multi_slots FROM need GROUP BY 1)
SELECT template_id, count(*) AS n_slots, string_agg(category, ',' ORDER BY slot_no) AS slot_categories, max(multi_slots) AS multi_slots FROM slots JOIN m USING (template_id) GROUP BY 1""",
)
def structure_features(spark, sf):
    f = T.structure_features(T.parse_slots(part_templates(spark, sf)))
    return f.withColumn("slot_categories", F.concat_ws(",", "slot_categories"))


USED = ["color_logic", "light_behavior", "medium_render", "subject_form"]


@query(
    "category_usage",
    f"""WITH {PART_TEMPLATES_SQL} SELECT template_id, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in USED)},
    count(*) FILTER (category IN ({', '.join(f"'{c}'" for c in USED)})) AS total FROM slots GROUP BY 1""",
)
def category_usage(spark, sf):
    return T.category_usage(T.parse_slots(part_templates(spark, sf)), USED)


# ---- generation ------------------------------------------------------------------------------------


def _plan(c: str, words: int | None = None) -> tuple[list[tuple[str, list[int]]], list[tuple[str, list[int]]], list[str]]:
    """Slots and draws of one type template, and its literals; ``words``: all a category has, to be reused when taken."""
    cats = [(c, 2), ("medium_render", 1), (c, 1), ("subject_form", 1), ("color_logic", 1)]
    draws: list[tuple[str, list[int]]] = []
    slots = []
    for cat, k in cats:
        mine = []
        taken = [i for i, d in enumerate(draws) if d[0] == cat]
        if words is not None and len(taken) >= words:
            taken = []
        for _ in range(k):
            draws.append((cat, [*taken, *mine]))
            mine.append(len(draws) - 1)
        slots.append((cat, mine))
    return slots, draws, ["", " beside ", ", ", " in ", ", ", " light"]


def generated_sql(n: str, body: str, words: int | None = None) -> str:
    """Prompts of all type templates by the same arithmetic; ``n`` is a scalar SQL expression.  With ``words`` each
    category has its first so many words only, and gives them again once they are taken."""
    parts = []
    order = sorted(TYPE_CATEGORY)
    negatable = ["color_logic", "light_behavior", "atmosphere_field", "temporal_state", "texture_density", "medium_render"]
    for t, p_type in enumerate(order):
        tid = p_type.lower()
        slots, draws, lit = _plan(TYPE_CATEGORY[p_type], words)
        cols = [f"rank * {len(order)} + {t} AS prompt_no", "rank", "rank AS q0"]
        for j, (cat, skip) in enumerate(draws):
            key = " || '/' || ".join([f"'42/{tid}/{j}'"] + [f"d{i}::VARCHAR" for i in range(j)])
            cols.append(f"n_{cat} - {len(skip)} AS m{j}")
            cols.append(f"(q{j} % m{j} + ('0x' || substr(md5({key}), 1, 15))::BIGINT % m{j}) % m{j} AS d{j}")
            cols.append(f"q{j} // m{j} AS q{j + 1}")
            if skip:
                used = ", ".join(f"i{i}" for i in skip)
                cols.append(f"list_reduce(list_prepend(d{j}, list_sort([{used}])), lambda x, u: CASE WHEN x >= u THEN x + 1 ELSE x END) AS i{j}")
            else:
                cols.append(f"d{j} AS i{j}")
            cols.append(f"w_{cat}[i{j} + 1] AS w{j}")
            cols.append(f"o_{cat}[i{j} + 1] AS o{j}")
        text = []
        for piece, slot in zip(lit, [*slots, None]):
            if piece:
                text.append(f"'{piece}'")
            if slot:
                text.append(" || ', ' || ".join(f"w{j}" for j in slot[1]))
        by_cat: dict[str, list[int]] = {}
        for j, (cat, _) in enumerate(draws):
            by_cat.setdefault(cat, []).append(j)
        canon = ", ".join(
            f'"{c}": [\' || array_to_string(list_transform(list_sort([{", ".join(f"w{j}" for j in by_cat[c])}]), lambda x: \'"\' || x || \'"\'), \', \') || \']' for c in sorted(by_cat)
        )
        against = [f"o{j}" for c in negatable for j in by_cat.get(c, [])]
        cols.append(" || ';' || ".join(f"'{c}=' || array_to_string([{', '.join(f'w{j}' for j in by_cat[c])}], '|')" for c in sorted(by_cat)) + " AS parts")
        cols.append(" * ".join(f"m{j}" for j in range(len(draws))) + " AS capacity")
        cols.append(f"'{tid}' AS template_id")
        cols.append(f"{' || '.join(text)} AS positive")
        cols.append(f"concat_ws(', ', {', '.join(against)}, 'low quality', 'blurry', 'text', 'watermark') AS negative")
        cols.append(f"substr(sha256('{{\"c\": {{{canon}}}, \"t\": \"{tid}\"}}'), 1, 16) AS hash")
        parts.append(f"SELECT prompt_no, rank, template_id, positive, negative, hash, parts FROM (SELECT {', '.join(cols)} FROM (SELECT range AS rank FROM range(0, {n})) CROSS JOIN dims) WHERE rank < capacity")
    used_cats = sorted({*TYPE_CATEGORY.values()})
    dims = ", ".join(
        f"count(*) FILTER (category = '{c}') AS n_{c}, list(word ORDER BY ordinal) FILTER (category = '{c}') AS w_{c}, list(opposite ORDER BY ordinal) FILTER (category = '{c}') AS o_{c}" for c in used_cats
    )
    some = "comp" if words is None else f"(SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY category ORDER BY ordinal) <= {words})"
    return f"WITH {COMPONENTS_SQL}, dims AS (SELECT {dims} FROM {some}), gen AS ({' UNION ALL '.join(parts)}) {body}"


N_PART = "(SELECT count(*) FROM part)"


def _generated(spark, sf, **kw):
    """As many prompts per template as there are parts."""
    n = table(spark, sf, "part").count()
    return G.generate(type_templates(spark, sf), components(spark, sf), n, **kw)


@query("generated_prompts", generated_sql(N_PART, "SELECT prompt_no, template_id, positive, negative, hash FROM gen"))
def generated_prompts(spark, sf):
    return _generated(spark, sf).select("prompt_no", "template_id", "positive", "negative", "hash")


@query("generated_prompts_by_join", generated_sql(N_PART, "SELECT prompt_no, template_id, positive, negative, hash FROM gen"))
def generated_prompts_by_join(spark, sf):
    """The form for pools too large to be literals of the plan."""
    return _generated(spark, sf, literal_words=0).select("prompt_no", "template_id", "positive", "negative", "hash")


@query(
    "distinct_generated",
    generated_sql(N_PART, "SELECT template_id, count(*) AS prompts, count(DISTINCT hash) AS hashes, count(DISTINCT positive) AS texts FROM gen GROUP BY 1"),
)
def distinct_generated(spark, sf):
    return _generated(spark, sf).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_distinct("hash").alias("hashes"), F.count_distinct("positive").alias("texts")
    )


@query("sample_prompts", generated_sql(N_PART, "SELECT template_id, rank + 1 AS place, CASE WHEN length(positive) > 40 THEN substr(positive, 1, 40) || '...' ELSE positive END AS sample FROM gen WHERE rank < 5"))
def sample_prompts(spark, sf):
    s = G.first_samples(_generated(spark, sf), 5, 40)
    return s.withColumn("place", F.col("place").cast("bigint"))


@query(
    "artifact_flags",
    generated_sql(N_PART, "SELECT hash, template_id FROM gen WHERE ('0x' || substr(md5(hash), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.002"),
)
def artifact_flags(spark, sf):
    return G.flag_artifacts(_generated(spark, sf)).filter("is_artifact").select("hash", "template_id")


@query("reused_words", generated_sql(N_PART, "SELECT prompt_no, template_id, positive FROM gen", words=2))
def reused_words(spark, sf):
    """Each category has its first two words only, and the templates ask for three or more: the words come again."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("category").orderBy("ordinal"))
    few = components(spark, sf).withColumn("place", place).filter("place <= 2").drop("place")
    g = G.generate(type_templates(spark, sf), few, table(spark, sf, "part").count(), reuse=True, leave_missing=True)
    return g.select("prompt_no", "template_id", "positive")


@query(
    "unique_prompts",
    generated_sql(
        f"{N_PART} * 2",
        f""", old AS (SELECT hash FROM gen WHERE rank < {N_PART}), new AS (SELECT hash, min(prompt_no) AS prompt_no FROM gen WHERE rank >= {N_PART} AND hash NOT IN (SELECT hash FROM old) GROUP BY 1)
SELECT gen.prompt_no, gen.template_id, gen.hash FROM gen JOIN new USING (prompt_no) ORDER BY prompt_no LIMIT {N_PART}""",
    ),
)
def unique_prompts(spark, sf):
    """As many prompts as there are parts, none of whose hashes an earlier run produced."""
    n = table(spark, sf, "part").count()
    path = fresh_path(spark, "seen")
    _generated(spark, sf).select("hash").write.parquet(path)
    old = spark.read.parquet(path)
    new = G.generate_unique(type_templates(spark, sf), components(spark, sf), n, old)
    return new.select("prompt_no", "template_id", "hash")


@query(
    "batch_run",
    f"SELECT count(*) AS total, count(*) AS hashes, 0::BIGINT AS favorites FROM part",
)
def batch_run(spark, sf):
    """Generate, append twice (the second append adds nothing) and read the history back."""
    path = fresh_path(spark, "history")
    rows = B.run_batch(type_templates(spark, sf), components(spark, sf), table(spark, sf, "part").count(), path)
    append_new(rows, path)
    h = read_history(spark, path)
    return h.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("hash").alias("hashes"), F.count_if("favorited").alias("favorites"))


@query(
    "batch_run_rows",
    generated_sql(
        f"{N_PART} * 2",
        f""", d AS (SELECT hash, min(prompt_no) AS prompt_no FROM gen GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY prompt_no) AS id, hash, prompt_no FROM d)
SELECT (CASE WHEN id <= {N_PART} THEN 1 ELSE 2 END)::INTEGER AS call, id, o.hash, template_id FROM o JOIN gen USING (prompt_no) WHERE id <= 2 * {N_PART}""",
    ),
)
def batch_run_rows(spark, sf):
    """The rows that two calls on one table return; they are what it holds."""
    path, n = fresh_path(spark, "history"), table(spark, sf, "part").count()
    calls = [B.run_batch(type_templates(spark, sf), components(spark, sf), n, path).withColumn("call", F.lit(k)) for k in (1, 2)]
    rows = calls[0].unionByName(calls[1]).select("call", "id", "hash", "template_id")
    return rows.join(read_history(spark, path).select("id", "hash", "template_id"), ["id", "hash", "template_id"], "left_semi")


def _sampled_sql() -> str:
    parts = []
    for c in sorted(TYPE_CATEGORY.values()):
        h = lambda j, keys: f"('0x' || substr(md5('42/sample/{c}/{j}'{keys}), 1, 15))::BIGINT"
        parts.append(f"""SELECT key, '{c}' AS category, unnest([0, 1]) AS draw, unnest([w[i0 + 1], w[i1 + 1]]) AS word FROM (
            SELECT key, w, (key % n + {h(0, '')} % n) % n AS i0, ((key // n) % (n - 1) + {h(1, " || '/' || i0::VARCHAR")} % (n - 1)) % (n - 1) AS d1, d1 + CASE WHEN d1 >= i0 THEN 1 ELSE 0 END AS i1
            FROM (SELECT p_partkey AS key FROM part) CROSS JOIN (SELECT count(*) AS n, list(word ORDER BY ordinal) AS w FROM comp WHERE category = '{c}'))""")
    return f"WITH {COMPONENTS_SQL} {' UNION ALL '.join(parts)}"


@query("sampled_words", _sampled_sql())
def sampled_words(spark, sf):
    """Two different words of every category for each part."""
    return G.sample_words(components(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("key")), 2)


SPANS = """hit AS (SELECT id, category, word, len(p) - 1 AS n, list_transform(p, lambda x: length(x)) AS ls, length(word) AS w FROM
    (SELECT *, string_split(text, word) AS p FROM txt) WHERE len(p) > 1),
pos AS (SELECT id, category, word, w, unnest(list_transform(range(1, n + 1), lambda k: list_sum(ls[1:k])::BIGINT + (k - 1) * w)) AS start FROM hit)"""


@query(
    "prompt_spans",
    f"""WITH txt AS (SELECT doc_id AS id, text, unnest(['head', 'tail']) AS category, unnest([string_split(text, ' ')[1], string_split(text, ' ')[-1]]) AS word FROM documents), {SPANS}
SELECT id, category, word, start::INTEGER AS start, (start + w)::INTEGER AS "end" FROM pos WHERE word <> ''""",
)
def prompt_spans(spark, sf):
    """Every place of the first and the last token of each whole text."""
    d = table(spark, sf, "documents")
    tokens = F.split("text", " ")
    comps = F.create_map(F.lit("head"), F.array(F.element_at(tokens, 1)), F.lit("tail"), F.array(F.element_at(tokens, -1)))
    return ST.spans(d.select(F.col("doc_id").alias("id"), "text", comps.alias("components")))


# ---- profiles --------------------------------------------------------------------------------------


def _vectors(spark, sf):
    """Vectors of generated prompts: one per template for every part."""
    n = max(2, table(spark, sf, "part").count())
    return PF.sample_vectors(type_templates(spark, sf), components(spark, sf), n, reuse=False)


VECTORS = generated_sql(
    "(SELECT greatest(2, count(*)) FROM part)",
    f""", w AS (SELECT DISTINCT positive AS word FROM gen), vv AS (SELECT * FROM {encoder_sql('w', 'v:', 64, 3)}), sv AS (SELECT * FROM {encoder_sql('w', 's:', 96, 4)}),
tot AS (SELECT 'v' AS space, template_id, p, sum(v) AS x FROM gen JOIN vv ON gen.positive = vv.word GROUP BY ALL UNION ALL SELECT 's', template_id, p, sum(v) FROM gen JOIN sv ON gen.positive = sv.word GROUP BY ALL),
cnt AS (SELECT template_id, count(*) AS n FROM gen GROUP BY 1), dot AS (SELECT a.space, a.template_id AS a, b.template_id AS b, sum(a.x * b.x) AS s FROM tot a JOIN tot b USING (space, p) GROUP BY ALL),
mat AS (SELECT space, a, b, CASE WHEN a = b THEN (s - x.n) / (x.n * (x.n - 1)) ELSE s / (x.n * y.n) END AS mean, s, x.n AS na, y.n AS nb FROM dot JOIN cnt x ON x.template_id = a JOIN cnt y ON y.template_id = b)""",
)


@query(
    "template_matrix",
    f"""{VECTORS} SELECT a, b, round(max(mean) FILTER (space = 'v'), 6) + 0.0 AS visual_mean, round(max(mean) FILTER (space = 's'), 6) + 0.0 AS semantic_mean FROM mat GROUP BY ALL""",
)
def template_matrix(spark, sf):
    return rounded(PF.template_matrix(_vectors(spark, sf)), "visual_mean", "semantic_mean")


@query(
    "template_cross_means",
    f"""{VECTORS}, c AS (SELECT space, a, sum(s) FILTER (a <> b) / (max(na) * sum(nb) FILTER (a <> b)) AS m FROM mat GROUP BY ALL)
SELECT a AS template_id, round(max(m) FILTER (space = 'v'), 6) + 0.0 AS visual_cross_mean, round(max(m) FILTER (space = 's'), 6) + 0.0 AS semantic_cross_mean FROM c GROUP BY 1""",
)
def template_cross_means(spark, sf):
    return rounded(PF.cross_means(_vectors(spark, sf)), "visual_cross_mean", "semantic_cross_mean")


@query(
    "extreme_templates",
    f"""{VECTORS}, p AS (SELECT a, b, mean FROM mat WHERE space = 'v' AND a < b)
(SELECT 'most_distinct' AS kind, a, b, round(mean, 6) + 0.0 AS similarity FROM p ORDER BY mean, a, b LIMIT 1)
UNION ALL (SELECT 'most_similar', a, b, round(mean, 6) + 0.0 FROM p ORDER BY mean DESC, a, b LIMIT 1)""",
)
def extreme_templates(spark, sf):
    return rounded(PF.extreme_templates(PF.template_matrix(_vectors(spark, sf))), "similarity")


SCORES = ("combined_score", "internal_score", "uniqueness_score")


def _profiles(spark, sf):
    return PF.profile_templates(type_templates(spark, sf), components(spark, sf), 0, vectors=_vectors(spark, sf))


PAIRED = f"""{VECTORS}, pos AS (SELECT range AS p FROM range(1, 97)),
dense AS (SELECT w.word, list(coalesce(vv.v, 0.0)::DOUBLE ORDER BY pos.p) FILTER (pos.p <= 64) AS a, list(coalesce(sv.v, 0.0)::DOUBLE ORDER BY pos.p) AS b
    FROM w CROSS JOIN pos LEFT JOIN vv ON vv.word = w.word AND vv.p = pos.p LEFT JOIN sv ON sv.word = w.word AND sv.p = pos.p GROUP BY 1),
pv AS (SELECT prompt_no, template_id, a, b FROM gen JOIN dense ON gen.positive = dense.word)"""


@query(
    "template_profiles",
    f"""{PAIRED}, q AS (SELECT x.template_id, list_dot_product(x.a, y.a) AS v, list_dot_product(x.b, y.b) AS s FROM pv x JOIN pv y ON x.template_id = y.template_id AND x.prompt_no < y.prompt_no),
i AS (SELECT template_id, (1 - avg(v)) * 0.6 + (max(v) - min(v)) * 0.4 AS vi, (1 - avg(s)) * 0.6 + (max(s) - min(s)) * 0.4 AS si FROM q GROUP BY 1),
cm AS (SELECT space, a, sum(s) FILTER (a <> b) / (max(na) * sum(nb) FILTER (a <> b)) AS m FROM mat GROUP BY ALL),
u AS (SELECT a AS template_id, 1 - max(m) FILTER (space = 'v') AS vu, 1 - max(m) FILTER (space = 's') AS su FROM cm GROUP BY 1),
f AS (SELECT template_id, least(vi, si) AS internal_score, greatest(vu, su) AS uniqueness_score, least(vi, si) * 0.5 + greatest(vu, su) * 0.5 AS combined_score FROM i JOIN u USING (template_id))
SELECT row_number() OVER (ORDER BY combined_score DESC, template_id)::INTEGER AS rank, f.template_id, cnt.n AS n_samples, 5::BIGINT AS n_slots,
    1::BIGINT AS multi_slots,
    round(combined_score, 6) + 0.0 AS combined_score, round(internal_score, 6) + 0.0 AS internal_score, round(uniqueness_score, 6) + 0.0 AS uniqueness_score FROM f JOIN cnt USING (template_id)""",
)
def template_profiles(spark, sf):
    p = PF.rank_profiles(_profiles(spark, sf))
    return rounded(p.select("rank", "template_id", "n_samples", "n_slots", "multi_slots", *SCORES), *SCORES)


@query("profile_against_baseline")
def profile_against_baseline(spark, sf):
    """Profiles with the pool against profiles with the pool of the large parts only."""
    c = components(spark, sf)
    base = PF.profile_templates(type_templates(spark, sf), c.filter("opposite is not null"), max(2, table(spark, sf, "part").count()))
    d = PF.against_baseline(_profiles(spark, sf), base)
    return rounded(d, *SCORES, *[f"delta_{s}" for s in SCORES])


@query(
    "prompt_diversity",
    f"""{PAIRED}, q AS (SELECT x.template_id AS t, y.template_id AS u, 0.5 * list_dot_product(x.a, y.a) + 0.5 * list_dot_product(x.b, y.b) AS s FROM pv x JOIN pv y ON x.prompt_no < y.prompt_no)
SELECT t AS template_id, max(cnt.n) AS "count", round(avg(s), 6) + 0.0 AS mean_similarity, round(min(s), 6) + 0.0 AS min_similarity, round(max(s), 6) + 0.0 AS max_similarity FROM q JOIN cnt ON cnt.template_id = t WHERE t = u GROUP BY t
UNION ALL SELECT NULL, (SELECT count(*) FROM gen), round(avg(s), 6) + 0.0, round(min(s), 6) + 0.0, round(max(s), 6) + 0.0 FROM q""",
)
def prompt_diversity(spark, sf):
    d = PF.prompt_diversity(_vectors(spark, sf))
    return rounded(d, "mean_similarity", "min_similarity", "max_similarity")
