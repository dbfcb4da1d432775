"""Queries over pools of words and raw texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.encoders import embed_models, embed_text, ngram_encoder, pool_tokens
from wordloom.functions.hashing import fnv_bucket, md5_bucket
from wordloom.functions.presets import EFFECT_FALLBACKS, EFFECT_KEYWORDS, PARTICLE_KEYWORDS, PARTICLES, joined, keyword_or_bucket
from wordloom.operators import curation as CU
from wordloom.operators import poolsets as P
from wordloom.operators import probes as PB
from wordloom.operators import terms as TE
from wordloom.operators.diversity import diversity
from wordloom.session import fresh_path
from wordloom.sources import pools as SP
from wordloom.sources import reports
from wordloom.sources import vectors as SV

from .base import COMPONENTS_SQL, PAIRS, POOLS, POOLS_SQL, components, pool_vectors, pools, query, r6, rounded, table

# ---- set analysis ----------------------------------------------------------------------------------


@query("distinct_words", f"WITH {POOLS_SQL} SELECT word, min(ordinal) AS ordinal FROM pools GROUP BY 1")
def distinct_words(spark, sf):
    return SP.distinct_words(pools(spark, sf))


@query("word_categories", f"WITH {POOLS_SQL} SELECT pool, word, category FROM wc")
def word_categories(spark, sf):
    return SP.word_category(pools(spark, sf))


@query("category_names", f"WITH {POOLS_SQL} SELECT DISTINCT category FROM pools")
def category_names(spark, sf):
    return SP.categories(pools(spark, sf))


@query(
    "pool_overlap",
    f"""WITH {POOLS_SQL}, n AS (SELECT pool, count(*) AS n FROM wc GROUP BY 1),
s AS (SELECT a.pool AS pool_a, b.pool AS pool_b, count(*) AS c FROM wc a JOIN wc b ON a.word = b.word AND a.pool < b.pool GROUP BY ALL)
SELECT x.pool AS pool_a, y.pool AS pool_b, coalesce(c, 0) AS shared, x.n - coalesce(c, 0) AS only_a, y.n - coalesce(c, 0) AS only_b,
    round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 4) AS jaccard
FROM n x JOIN n y ON x.pool < y.pool LEFT JOIN s ON s.pool_a = x.pool AND s.pool_b = y.pool""",
)
def pool_overlap(spark, sf):
    return P.pool_overlap(pools(spark, sf))


@query(
    "category_agreement",
    f"""WITH {POOLS_SQL} SELECT a.pool AS pool_a, b.pool AS pool_b, count(*) AS shared, count(*) FILTER (a.category = b.category) AS same_category,
    count(*) FILTER (a.category <> b.category) AS other_category FROM wc a JOIN wc b ON a.word = b.word AND a.pool < b.pool GROUP BY ALL""",
)
def category_agreement(spark, sf):
    return P.category_agreement(pools(spark, sf))


@query(
    "category_disagreements",
    f"""WITH {POOLS_SQL}, d AS (SELECT a.pool AS pool_a, b.pool AS pool_b, a.word, a.category AS category_a, b.category AS category_b,
    row_number() OVER (PARTITION BY a.pool, b.pool ORDER BY a.word) AS rank FROM wc a JOIN wc b ON a.word = b.word AND a.pool < b.pool WHERE a.category <> b.category)
SELECT pool_a, pool_b, word, category_a, category_b, rank::INTEGER AS rank FROM d WHERE rank <= 10""",
)
def category_disagreements(spark, sf):
    return P.category_disagreements(pools(spark, sf)).select("pool_a", "pool_b", "word", "category_a", "category_b", "rank")


@query(
    "consensus_words",
    f"""WITH {POOLS_SQL} SELECT max(category) FILTER (pool = 'large') AS category, word FROM wc GROUP BY word
HAVING count(*) = (SELECT count(DISTINCT pool) FROM pools)""",
)
def consensus_words(spark, sf):
    return P.consensus(pools(spark, sf), "large")


@query("unique_words", f"WITH {POOLS_SQL} SELECT min(pool) AS pool, min(category) AS category, word FROM wc GROUP BY word HAVING count(*) = 1")
def unique_words(spark, sf):
    return P.unique_words(pools(spark, sf))


@query(
    "pool_sizes",
    f"""WITH {POOLS_SQL} SELECT coalesce(category, 'TOTAL') AS category, count(*) FILTER (pool = 'large') AS large,
    count(*) FILTER (pool = 'medium') AS medium, count(*) FILTER (pool = 'small') AS small FROM pools GROUP BY ROLLUP (category)""",
)
def pool_sizes(spark, sf):
    return P.pool_sizes(pools(spark, sf), POOLS)


@query("count_by_category", f'WITH {POOLS_SQL} SELECT category, count(*) AS "count" FROM pools GROUP BY 1')
def count_by_category(spark, sf):
    return SP.count_by_category(pools(spark, sf))


@query(
    "subset_filter",
    f"WITH {POOLS_SQL} SELECT pool, category, count(*) AS n FROM pools WHERE pool IN ('small', 'large') GROUP BY ALL",
)
def subset_filter(spark, sf):
    return SP.only(pools(spark, sf), "pool", ["small", "large"]).groupBy("pool", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seed_words",
    f"""WITH {COMPONENTS_SQL}, def AS (SELECT DISTINCT category FROM comp UNION ALL SELECT 'without_words')
SELECT def.category, comp.word AS seed FROM def LEFT JOIN comp USING (category)""",
)
def seed_words(spark, sf):
    c = components(spark, sf)
    defs = c.select("category").distinct().unionByName(spark.createDataFrame([("without_words",)], "category string"))
    return SP.seed_words(defs, c).select("category", "seed")


def _two(v):
    """Two pools of vectors: some categories only in the old one, some only in the new one."""
    pool = F.when(F.col("category") < 2, "old").when(F.col("category") >= 8, "new").when(F.col("ordinal") % 2 == 0, "old").otherwise("new")
    return v.withColumn("pool", pool)


COMPARE = f"""{PAIRS}, side AS (SELECT category, ordinal, CASE WHEN category < 2 THEN 'old' WHEN category >= 8 THEN 'new' WHEN ordinal % 2 = 0 THEN 'old' ELSE 'new' END AS side FROM pv),
m AS (SELECT p.category, x.side, avg(0.5 * sv + 0.5 * ss) AS mean FROM pairs p JOIN side x ON x.ordinal = p.i JOIN side y ON y.ordinal = p.j AND x.side = y.side GROUP BY ALL),
c AS (SELECT category, side, count(*) AS c FROM side GROUP BY ALL),
o AS (SELECT c.category, c.c, mean FROM c LEFT JOIN m USING (category, side) WHERE side = 'old'), n AS (SELECT c.category, c.c, mean FROM c LEFT JOIN m USING (category, side) WHERE side = 'new'),
cmp AS (SELECT coalesce(o.category, n.category) AS category, o.c AS old_count, n.c AS new_count, o.mean AS old_mean, n.mean AS new_mean, n.mean - o.mean AS delta,
    CASE WHEN o.c IS NULL THEN 'new category' WHEN n.c IS NULL THEN 'removed' WHEN n.mean - o.mean < -0.005 THEN 'better' WHEN n.mean - o.mean > 0.005 THEN 'worse' ELSE 'same' END AS verdict
    FROM o FULL JOIN n ON o.category = n.category)"""


def _compared(spark, sf):
    d = diversity(_two(pool_vectors(spark, sf)), "joint", by=["pool", "category"])
    pick = lambda p: d.filter(F.col("pool") == p).select("category", "count", "mean_similarity")
    return P.compare_means(pick("old"), pick("new"))


@query(
    "pool_comparison",
    f"WITH {COMPARE} SELECT category, old_count, new_count, round(old_mean, 6) + 0.0 AS old_mean, round(new_mean, 6) + 0.0 AS new_mean, round(delta, 6) + 0.0 AS delta, verdict FROM cmp",
)
def pool_comparison(spark, sf):
    return rounded(_compared(spark, sf), "old_mean", "new_mean", "delta")


@query(
    "pool_comparison_summary",
    f"""WITH {COMPARE} SELECT count(*) FILTER (verdict = 'better') AS improved, count(*) FILTER (verdict = 'worse') AS degraded,
    count(*) FILTER (verdict NOT IN ('better', 'worse')) AS unchanged FROM cmp""",
)
def pool_comparison_summary(spark, sf):
    return P.comparison_summary(_compared(spark, sf))


# ---- curation --------------------------------------------------------------------------------------


def _pool(spark, sf, name):
    p = pools(spark, sf).filter(F.col("pool") == name)
    return p.groupBy("category", "word").agg(F.min("ordinal").alias("ordinal"))


def _rules(spark, sf) -> CU.Rules:
    """Rules derived from the words of all pools."""
    w = pools(spark, sf).select("word", "category", "ordinal")
    names = w.select("word").distinct()
    first = w.filter(F.col("word").startswith("blue ")).groupBy("word").agg(F.min("category").alias("from_category"))
    back = pools(spark, sf).filter("pool = 'large' and word like 'small %'").groupBy("category", "word").agg(F.min("ordinal").alias("place"))
    return CU.Rules(
        garbage=names.filter(F.col("word").endswith("Brand#7")),
        removed=names.filter(F.col("word").startswith("red ") & F.col("word").contains("#1")),
        moves=first.withColumn("to_category", F.lit("STANDARD")),
        duplicates=names.filter(F.col("word").startswith("green ")).select(F.regexp_replace("word", "^green", "red").alias("keep"), F.col("word").alias("drop")),
        restores=back,
    )


CURATE = f"""{POOLS_SQL}, start AS (SELECT category, word, min(ordinal) AS ordinal FROM pools WHERE pool = 'medium' GROUP BY ALL),
s1 AS (SELECT * FROM start WHERE NOT word LIKE '% Brand#7'), s2 AS (SELECT * FROM s1 WHERE NOT (word LIKE 'red %' AND word LIKE '%#1%')),
rule AS (SELECT word, min(category) AS category FROM pools WHERE word LIKE 'blue %' GROUP BY 1),
mov AS (SELECT s2.word, s2.category FROM s2 JOIN rule ON s2.word = rule.word AND s2.category = rule.category),
stay AS (SELECT s2.category, s2.word FROM s2 WHERE NOT EXISTS (SELECT 1 FROM mov WHERE mov.word = s2.word AND mov.category = s2.category)),
s3 AS (SELECT category, word FROM stay UNION ALL SELECT 'STANDARD', word FROM mov WHERE NOT EXISTS (SELECT 1 FROM stay WHERE stay.word = mov.word AND stay.category = 'STANDARD')),
s4 AS (SELECT * FROM s3 WHERE NOT word LIKE 'green %'),
res0 AS (SELECT category, word, min(ordinal) AS place FROM pools WHERE pool = 'large' AND word LIKE 'small %' GROUP BY ALL),
res AS (SELECT arg_min(category, place) AS category, word FROM res0 WHERE word NOT IN (SELECT word FROM s4)
    AND category IN (SELECT category FROM start UNION SELECT 'STANDARD' FROM mov) GROUP BY word)"""


@query("curated_pool", f"WITH {CURATE} SELECT category, word FROM s4 UNION ALL SELECT category, word FROM res")
def curated_pool(spark, sf):
    out = CU.curate(_pool(spark, sf, "medium"), _rules(spark, sf), _pool(spark, sf, "large"))
    return out.select("category", "word")


@query(
    "curation_log",
    f"""WITH {CURATE} SELECT 'garbage' AS step, word, category AS from_category, NULL::VARCHAR AS to_category FROM start WHERE word LIKE '% Brand#7'
UNION ALL SELECT 'remove', word, category, NULL FROM s1 WHERE word LIKE 'red %' AND word LIKE '%#1%'
UNION ALL SELECT 'move', word, category, 'STANDARD' FROM mov
UNION ALL SELECT 'duplicate', word, category, NULL FROM s3 WHERE word LIKE 'green %'
UNION ALL SELECT 'restore', word, category, NULL FROM res""",
)
def curation_log(spark, sf):
    return CU.curation_log(_pool(spark, sf, "medium"), _rules(spark, sf), _pool(spark, sf, "large"))


@query(
    "curation_review",
    f"""WITH {CURATE}, a AS (SELECT 'garbage' AS step, word FROM start WHERE word LIKE '% Brand#7'
UNION ALL SELECT 'remove', word FROM start WHERE word LIKE 'red %' AND word LIKE '%#1%'
UNION ALL SELECT 'move', start.word FROM start JOIN rule ON start.word = rule.word AND start.category = rule.category
UNION ALL SELECT 'duplicate', word FROM start WHERE word LIKE 'green %'
UNION ALL SELECT 'restore', word FROM res0 WHERE word NOT IN (SELECT word FROM start) AND category IN (SELECT category FROM start))
SELECT step, count(*) AS actions FROM a GROUP BY 1""",
)
def curation_review(spark, sf):
    log = CU.curation_log(_pool(spark, sf, "medium"), _rules(spark, sf), _pool(spark, sf, "large"), as_review=True)
    return log.groupBy("step").agg(F.count(F.lit(1)).alias("actions"))


@query(
    "void_words",
    """WITH w AS (SELECT unnest([p_name || ' ' || p_brand, '', p_name]) AS word FROM part), deny AS (SELECT DISTINCT p_name || ' ' || p_brand AS word FROM part WHERE p_type = 'ECONOMY')
SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN (SELECT word FROM deny) GROUP BY 1""",
)
def void_words(spark, sf):
    p = table(spark, sf, "part")
    word = F.concat_ws(" ", "p_name", "p_brand")
    probe = p.select(F.array(*[F.struct(F.lit(0.5).alias("distance"), x.alias("nearest")) for x in (word, F.lit(""), F.col("p_name"))]).alias("voids"))
    deny = p.filter("p_type = 'ECONOMY'").select(word.alias("word"))
    return CU.void_words(probe, deny).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ---- pool sinks ------------------------------------------------------------------------------------


@query("word_snapshot", f"WITH {POOLS_SQL} SELECT DISTINCT category, word FROM pools")
def word_snapshot(spark, sf):
    """Written in sorted order and read back."""
    path = fresh_path(spark, "snapshot")
    SP.write_pool(SP.word_snapshot(pools(spark, sf)), path, ["category", "word"])
    return spark.read.parquet(path)


@query(
    "updated_opposites",
    f"""WITH {COMPONENTS_SQL}, nxt AS (SELECT category, word, lead(word) OVER (PARTITION BY category ORDER BY ordinal) AS nw FROM comp)
SELECT comp.category, comp.word, coalesce(CASE WHEN comp.word LIKE 'red %' THEN nw END, opposite) AS opposite FROM comp JOIN nxt ON comp.category = nxt.category AND comp.word = nxt.word""",
)
def updated_opposites(spark, sf):
    from pyspark.sql import Window

    path = fresh_path(spark, "pool")
    components(spark, sf).write.parquet(path)
    c = spark.read.parquet(path)
    w = Window.partitionBy("category").orderBy("ordinal")
    pairs = c.select("category", "word", F.lead("word").over(w).alias("opposite")).filter(F.col("word").startswith("red "))
    SP.replace_table(spark, SP.update_opposites(c, pairs.filter("opposite is not null")), path)
    return spark.read.parquet(path).select("category", "word", "opposite")


@query(
    "report_tables",
    f"""WITH {POOLS_SQL} SELECT pool, category, count(*) AS items, count(DISTINCT word) AS words FROM pools GROUP BY ALL""",
)
def report_tables(spark, sf):
    folder = fresh_path(spark, "report")
    p = pools(spark, sf)
    items = p.groupBy("pool", "category").agg(F.count(F.lit(1)).alias("items"))
    words = p.groupBy("pool", "category").agg(F.count_distinct("word").alias("words"))
    reports.write_report({"items": items, "words": words}, folder, "json")
    read = lambda n, c: spark.read.schema(f"pool string, category string, {c} bigint").json(f"{folder}/{n}")
    return read("items", "items").join(read("words", "words"), ["pool", "category"])


# ---- hashing and presets ---------------------------------------------------------------------------

FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({w}, ''), lambda x: unicode(x)::BIGINT)),
    lambda h, x: (xor(h, x) * 16777619) & 4294967295)"""


@query(
    "stable_buckets",
    f"""WITH w AS (SELECT p_name || ' ' || p_brand AS word FROM part UNION SELECT n_name FROM nation)
SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % 8 AS md5_bucket, {FNV.format(w='word')} % 11 AS fnv_bucket FROM w""",
)
def stable_buckets(spark, sf):
    w = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("word"))
    w = w.union(table(spark, sf, "nation").select("n_name")).distinct()
    return w.select("word", md5_bucket(F.col("word"), 8).alias("md5_bucket"), fnv_bucket(F.col("word"), 11).alias("fnv_bucket"))


def _map_sql(values: dict[str, str]) -> str:
    return "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(
    "keyword_presets",
    f"""WITH w AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), ' ' || upper(p_name), 'Fog', ' dust motes', 'CRT', '3d render']) AS word FROM part),
k AS (SELECT word, trim(lower(word)) AS k FROM w), f AS (SELECT *, ({FNV.format(w='k')} % 8)::INTEGER AS b FROM k)
SELECT word, coalesce({_map_sql(PARTICLE_KEYWORDS)}, ({PARTICLES!r})[b + 1]) AS particles, coalesce({_map_sql(joined(EFFECT_KEYWORDS))}, ({joined(EFFECT_FALLBACKS)!r})[b + 1]) AS effects FROM f""",
)
def keyword_presets(spark, sf):
    p = table(spark, sf, "part")
    words = F.array(F.split("p_name", " ")[0], F.concat(F.lit(" "), F.upper("p_name")), *[F.lit(x) for x in ("Fog", " dust motes", "CRT", "3d render")])
    w = p.select(F.explode(words).alias("word")).distinct()
    return w.select(
        "word",
        keyword_or_bucket(F.col("word"), PARTICLE_KEYWORDS, PARTICLES).alias("particles"),
        keyword_or_bucket(F.col("word"), joined(EFFECT_KEYWORDS), joined(EFFECT_FALLBACKS)).alias("effects"),
    )


# ---- encoders --------------------------------------------------------------------------------------


def encoder_sql(words: str, salt: str, dim: int, n: int) -> str:
    """(word, p, v): the n-gram vector of every word in unit length; ``words`` is a relation with ``word``."""
    return f"""(WITH g AS (SELECT word, md5('{salt}' || unnest([substr(' ' || word || ' ', i, {n}) FOR i IN range(1, length(word) + 2 - {n} + 2)])) AS h FROM {words}),
    c AS (SELECT word, ('0x' || substr(h, 1, 8))::BIGINT % {dim} + 1 AS p, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM g GROUP BY ALL),
    z AS (SELECT word, sqrt(sum(s * s)) AS n FROM c GROUP BY 1)
    SELECT c.word, c.p, c.s / z.n AS v FROM c JOIN z USING (word) WHERE z.n > 0
    UNION ALL SELECT w.word, 1, 1.0 FROM {words} w WHERE w.word NOT IN (SELECT word FROM z WHERE n > 0))"""


@query(
    "text_vectors",
    f"""WITH w AS (SELECT DISTINCT p_name || ' ' || p_brand AS word FROM part), v AS (SELECT * FROM {encoder_sql('w', 'v:', 64, 3)}), s AS (SELECT * FROM {encoder_sql('w', 's:', 96, 4)}),
a AS (SELECT word, round(sum(v * p), 6) + 0.0 AS visual_sum FROM v GROUP BY 1), b AS (SELECT word, round(sum(v * p), 6) + 0.0 AS semantic_sum FROM s GROUP BY 1)
SELECT word, visual_sum, semantic_sum FROM a JOIN b USING (word)""",
)
def text_vectors(spark, sf):
    """Both spaces in one pass; each vector is shown by its position-weighted sum."""
    w = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("word")).distinct()
    v = embed_text(w, "word", {"visual": "visual", "semantic": "semantic"})
    total = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("word", r6(total("visual")).alias("visual_sum"), r6(total("semantic")).alias("semantic_sum"))


@query(
    "cached_vectors",
    f"""WITH w AS (SELECT p_name AS word FROM part UNION SELECT p_brand FROM part), v AS (SELECT * FROM {encoder_sql('w', 'v:', 64, 3)}), s AS (SELECT * FROM {encoder_sql('w', 's:', 96, 4)}),
a AS (SELECT word, round(sum(v * p), 6) + 0.0 AS visual_sum FROM v GROUP BY 1), b AS (SELECT word, round(sum(v * p), 6) + 0.0 AS semantic_sum FROM s GROUP BY 1)
SELECT word, visual_sum, semantic_sum FROM a JOIN b USING (word)""",
)
def cached_vectors(spark, sf):
    """Names first, then names and brands: the second call encodes the brands only."""
    part, path = table(spark, sf, "part"), fresh_path(spark, "cache")
    names, spaces = part.select(F.col("p_name").alias("word")), {"visual": "visual", "semantic": "semantic"}
    SV.embed_once(names, path, spaces)
    v = SV.embed_once(names.union(part.select("p_brand")).distinct(), path, spaces)
    total = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("word", r6(total("visual")).alias("visual_sum"), r6(total("semantic")).alias("semantic_sum"))


@query(
    "text_vectors_by_model",
    f"""WITH w AS (SELECT DISTINCT p_name AS word FROM part), l AS (SELECT 'visual' AS model, * FROM {encoder_sql('w', 'v:', 64, 3)} UNION ALL SELECT 'semantic', * FROM {encoder_sql('w', 's:', 96, 4)})
SELECT model, word, round(max(v), 6) + 0.0 AS top_entry, round(sum(v * v), 6) AS squared_length FROM l GROUP BY ALL""",
)
def text_vectors_by_model(spark, sf):
    w = table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct()
    m = embed_models(w, "word", ["visual", "semantic"])
    # absent entries are zeros in the vector and missing in the SQL, so the top entry is that of non-zero ones
    top = F.array_max(F.filter("vector", lambda x: x != 0))
    return m.select("model", "word", r6(top).alias("top_entry"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("squared_length"))


@query(
    "token_pooling",
    """WITH t AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS m, value AS x, (event_id % 7)::DOUBLE AS y FROM events),
p AS (SELECT user_id, sum(x * m) / greatest(sum(m), 1e-9) AS x, sum(y * m) / greatest(sum(m), 1e-9) AS y FROM t GROUP BY 1)
SELECT user_id, round(CASE WHEN x * x + y * y > 0 THEN x / sqrt(x * x + y * y) ELSE x END, 6) AS x, round(CASE WHEN x * x + y * y > 0 THEN y / sqrt(x * x + y * y) ELSE y END, 6) AS y FROM p""",
)
def token_pooling(spark, sf):
    e = table(spark, sf, "events")
    t = e.select("user_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"), F.array(F.col("value"), (F.col("event_id") % 7).cast("double")).alias("vector"))
    v = pool_tokens(t, ["user_id"])
    return v.select("user_id", r6(F.col("vector")[0]).alias("x"), r6(F.col("vector")[1]).alias("y"))


TOKENS = """tok AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents),
clean AS (SELECT DISTINCT trim(t) AS word FROM tok WHERE NOT starts_with(t, '<') AND length(t) >= 3 AND regexp_full_match(trim(t), '[\\x00-\\x7F]{2,}'))"""


@query("vocabulary_tokens", f"WITH {TOKENS} SELECT word AS token FROM clean")
def vocabulary_tokens(spark, sf):
    from wordloom.functions.text import vocabulary_token

    t = PB.text_tokens(table(spark, sf, "documents"))
    return t.select(vocabulary_token(F.col("token")).alias("token")).filter("token is not null").distinct()


@query(
    "vocabulary_mining",
    f"""WITH {TOKENS}, names AS (SELECT DISTINCT p_name AS word FROM part), cv AS (SELECT * FROM {encoder_sql('clean', 'm:', 32, 3)}), nv AS (SELECT * FROM {encoder_sql('names', 'm:', 32, 3)}),
dots AS (SELECT cv.word, nv.word AS near, sum(cv.v * nv.v) AS s FROM cv JOIN nv USING (p) GROUP BY ALL),
every AS (SELECT c.word, n.word AS near, coalesce(d.s, 0) AS s FROM clean c CROSS JOIN names n LEFT JOIN dots d ON d.word = c.word AND d.near = n.word)
SELECT word AS token, round(1 - max(s), 6) + 0.0 AS distance FROM every GROUP BY 1 ORDER BY round(1 - max(s), 9) DESC, word LIMIT 100""",
)
def vocabulary_mining(spark, sf):
    """All tokens of the whole texts against the part names."""
    t = PB.text_tokens(table(spark, sf, "documents"))
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("word")).agg(F.min("p_partkey").alias("ordinal"))
    maker = lambda: ngram_encoder(32, 3, "m:")
    base = embed_text(names, "word", {"vector": maker})
    mined = PB.mine_vocabulary(t, base, maker, 100)
    return rounded(mined.select("token", "distance"), "distance")


# ---- terms -----------------------------------------------------------------------------------------

BLANK = "E' \\t\\n\\r'"
TERMS = f"""line AS (SELECT doc_id, lang AS category, unnest(string_split(trim(text, {BLANK}), chr(10))) AS raw FROM documents),
bare AS (SELECT doc_id, category, trim(trim(regexp_replace(trim(raw, {BLANK}), '^[\\d.\\-*•]+\\s*', ''), '"''`'), {BLANK}) AS t FROM line),
term AS (SELECT doc_id, category, lower(t) AS term FROM bare WHERE length(t) > 1 AND length(t) < 60 AND len(regexp_split_to_array(t, '[ \\t\\n\\r]+')) <= 5)"""


@query("term_lines", f"WITH {TERMS} SELECT doc_id, category, term, count(*) AS n FROM term GROUP BY ALL")
def term_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), "text")
    return TE.parse_terms(d, ["doc_id", "category"]).groupBy("doc_id", "category", "term").agg(F.count(F.lit(1)).alias("n"))


def _terms(spark, sf):
    return TE.parse_terms(table(spark, sf, "documents").select(F.col("lang").alias("category"), "text"))


@query("term_fill_levels", f'WITH {TERMS} SELECT category, count(DISTINCT term) AS "count", count(DISTINCT term) < 300 AS incomplete FROM term GROUP BY 1')
def term_fill_levels(spark, sf):
    return TE.fill_levels(_terms(spark, sf))


def _known(spark, sf):
    """Terms of the conversations, filed under every language."""
    t = TE.parse_terms(table(spark, sf, "conversations").select(F.col("role").alias("category"), "text")).select("term")
    langs = F.explode(F.lit(["en", "fr", "de", "es"]))
    return t.distinct().select(langs.alias("category"), "term")


KNOWN = TERMS + f""", kline AS (SELECT unnest(string_split(trim(text, {BLANK}), chr(10))) AS raw FROM conversations),
kbare AS (SELECT trim(trim(regexp_replace(trim(raw, {BLANK}), '^[\\d.\\-*•]+\\s*', ''), '"''`'), {BLANK}) AS t FROM kline),
kterm AS (SELECT DISTINCT lower(t) AS term FROM kbare WHERE length(t) > 1 AND length(t) < 60 AND len(regexp_split_to_array(t, '[ \\t\\n\\r]+')) <= 5)"""


@query("new_terms", f"WITH {KNOWN} SELECT DISTINCT category, term FROM term WHERE term NOT IN (SELECT term FROM kterm)")
def new_terms(spark, sf):
    return TE.new_terms(_terms(spark, sf), _known(spark, sf))


@query("added_term_counts", f"WITH {KNOWN} SELECT category, count(DISTINCT term) AS added FROM term WHERE term NOT IN (SELECT term FROM kterm) GROUP BY 1")
def added_term_counts(spark, sf):
    return TE.added_counts(_terms(spark, sf), _known(spark, sf))


@query(
    "avoid_list",
    f"""WITH {TERMS}, d AS (SELECT DISTINCT category, term FROM term), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ('0x' || substr(md5('42/' || category || '/' || term), 1, 15))::BIGINT, term) AS r FROM d),
n AS (SELECT category, count(*) AS total FROM d GROUP BY 1)
SELECT n.category, string_agg(term, ', ' ORDER BY r) || CASE WHEN total > 60 THEN ' ... and ' || (total - 60)::VARCHAR || ' others' ELSE '' END AS avoid, count(*)::INTEGER AS listed, total
FROM n JOIN r ON n.category = r.category AND r.r <= 60 GROUP BY n.category, total""",
)
def avoid_list(spark, sf):
    return TE.avoid_list(_terms(spark, sf))
