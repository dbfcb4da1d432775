"""Tables, derived views and the helpers both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.vectors import unit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---- vectors: category = label, word = vec_id, two spaces from the halves of the embedding ---------

EMBEDDING_HALF = 32


def pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").alias("category"),
        F.col("vec_id").alias("ordinal"),
        F.col("vec_id").alias("word"),
        unit(F.slice("embedding", 1, EMBEDDING_HALF)).alias("visual"),
        unit(F.slice("embedding", EMBEDDING_HALF + 1, EMBEDDING_HALF)).alias("semantic"),
    )


def bands(df: DataFrame) -> DataFrame:
    """Three overlapping-free pools of vectors by place, for pool-wise reports."""
    return df.withColumn("pool", F.concat(F.lit("band_"), F.pmod("ordinal", F.lit(3)).cast("string")))


PV = """raw AS (SELECT label AS category, vec_id AS ordinal, vec_id AS word,
    list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a0, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b0 FROM embeddings),
nrm AS (SELECT *, sqrt(list_dot_product(a0, a0)) AS na, sqrt(list_dot_product(b0, b0)) AS nb FROM raw),
pv AS (SELECT category, ordinal, word, list_transform(a0, lambda x: x / na) AS a, list_transform(b0, lambda x: x / nb) AS b,
    'band_' || (ordinal % 3)::VARCHAR AS pool FROM nrm)"""

# all pairs inside a category, each once
PAIRS = PV + """,
pairs AS (SELECT x.category, x.ordinal AS i, y.ordinal AS j, list_dot_product(x.a, y.a) AS sv, list_dot_product(x.b, y.b) AS ss
    FROM pv x JOIN pv y ON x.category = y.category AND x.ordinal < y.ordinal)"""

# all pairs of the table, each once
ALLPAIRS = PV + """,
pairs AS (SELECT x.ordinal AS i, y.ordinal AS j, x.category AS ci, y.category AS cj,
    list_dot_product(x.a, y.a) AS sv, list_dot_product(x.b, y.b) AS ss FROM pv x JOIN pv y ON x.ordinal < y.ordinal)"""


def centroid_sql(keys: str = "category") -> str:
    return PV + f""",
flat AS (SELECT {keys}, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) AS p FROM pv),
mean AS (SELECT {keys}, p, avg(a) AS a, avg(b) AS b FROM flat GROUP BY ALL),
cen0 AS (SELECT {keys}, list(a ORDER BY p) AS a, list(b ORDER BY p) AS b FROM mean GROUP BY ALL),
cen AS (SELECT {keys}, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS a,
    list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))) AS b FROM cen0)"""


def closest_sql(scope: str = "") -> str:
    """Own and best similarity per word in each space."""
    keys = f"{scope}, category" if scope else "category"
    on = f"w.{scope} = c.{scope}" if scope else "true"
    return centroid_sql(keys) + f""",
score AS (SELECT w.pool, w.category, w.ordinal, w.word, c.category AS other, list_dot_product(w.a, c.a) AS sv, list_dot_product(w.b, c.b) AS ss,
    0.5 * list_dot_product(w.a, c.a) + 0.5 * list_dot_product(w.b, c.b) AS sj FROM pv w JOIN cen c ON {on}),
best AS (SELECT pool, category, ordinal, word,
    max(sv) FILTER (other = category) AS own_v, max(ss) FILTER (other = category) AS own_s, max(sj) FILTER (other = category) AS own_j,
    max(sv) AS best_v, max(ss) AS best_s, max(sj) AS best_j,
    arg_max(other, sv) AS says_v, arg_max(other, ss) AS says_s, arg_max(other, sj) AS says_j FROM score GROUP BY ALL)"""


# ---- pools of words from part ----------------------------------------------------------------------

POOLS = ["large", "medium", "small"]


def pools(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    band = F.when(F.col("p_size") <= 16, "small").when(F.col("p_size") <= 33, "medium").otherwise("large")
    return p.select(
        band.alias("pool"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ordinal"),
        F.concat_ws(" ", "p_name", "p_brand").alias("word"),
    )


POOLS_SQL = """pools AS (SELECT CASE WHEN p_size <= 16 THEN 'small' WHEN p_size <= 33 THEN 'medium' ELSE 'large' END AS pool,
    p_type AS category, p_partkey AS ordinal, p_name || ' ' || p_brand AS word FROM part),
wc AS (SELECT pool, word, arg_max(category, ordinal) AS category FROM pools GROUP BY ALL)"""

# categories of the generator for the part types
TYPE_CATEGORY = {
    "ECONOMY": "color_logic",
    "LARGE": "material_substance",
    "MEDIUM": "medium_render",
    "PROMO": "texture_density",
    "SMALL": "light_behavior",
    "STANDARD": "subject_form",
}


def _case(col: str, values: dict[str, str], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names per category, with an opposite for about half of them."""
    p = table(spark, sf, "part")
    cat = F.expr(_case("p_type", TYPE_CATEGORY, "setting_location"))
    return (
        p.groupBy(cat.alias("category"), F.col("p_name").alias("word"))
        .agg(F.min("p_partkey").alias("ordinal"), F.min("p_size").alias("s"))
        .select("category", "ordinal", "word", F.when(F.col("s") % 2 == 0, F.concat(F.lit("not "), F.col("word"))).alias("opposite"))
    )


COMPONENTS_SQL = f"""comp AS (SELECT {_case('p_type', TYPE_CATEGORY, 'setting_location')} AS category, p_name AS word, min(p_partkey) AS ordinal,
    CASE WHEN min(p_size) % 2 = 0 THEN 'not ' || p_name END AS opposite FROM part GROUP BY 1, p_name)"""


def part_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template per part, with all forms of the slot syntax and a category that has no words."""
    p = table(spark, sf, "part")
    cat = _case("p_type", TYPE_CATEGORY, "setting_location")
    return p.select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"),
        F.expr(
            f"""concat('{{', {cat}, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ':2' WHEN 2 THEN ':3:, ' WHEN 3 THEN ':2:' ELSE '::-' END,
            '}} of {{', split(p_name, ' ')[1], '}} and {{', {cat}, '}}, {{medium_render}} ', p_name)"""
        ).alias("structure"),
        F.array(F.expr(cat)).alias("required_components"),
        F.lit("").alias("notes"),
    )


PART_TEMPLATES_SQL = f"""tem AS (SELECT 't' || p_partkey::VARCHAR AS id,
    '{{' || {_case('p_type', TYPE_CATEGORY, 'setting_location')} || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ':2' WHEN 2 THEN ':3:, ' WHEN 3 THEN ':2:' ELSE '::-' END ||
    '}} of {{' || split_part(p_name, ' ', 2) || '}} and {{' || {_case('p_type', TYPE_CATEGORY, 'setting_location')} || '}}, {{medium_render}} ' || p_name AS structure FROM part),
slot0 AS (SELECT id AS template_id, unnest(regexp_extract_all(structure, '\\{{\\w+(?::\\d+)?(?::[^}}]*)?\\}}')) AS slot,
    generate_subscripts(regexp_extract_all(structure, '\\{{\\w+(?::\\d+)?(?::[^}}]*)?\\}}'), 1) - 1 AS slot_no FROM tem),
slots AS (SELECT template_id, slot_no, slot, regexp_extract(slot, '^\\{{(\\w+)', 1) AS category,
    coalesce(nullif(regexp_extract(slot, '^\\{{\\w+:(\\d+)', 1), ''), '1')::INTEGER AS "count",
    CASE WHEN regexp_matches(slot, '^\\{{\\w+(:\\d+)?:[^}}]*\\}}$') AND NOT regexp_matches(slot, '^\\{{\\w+:\\d+\\}}$')
         THEN regexp_extract(slot, '^\\{{\\w+(?::\\d+)?:([^}}]*)\\}}$', 1) ELSE ' ' END AS separator FROM slot0)"""


def type_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One template per part type: a double slot, the same category again, and a fixed text."""
    p = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    cat = _case("p_type", TYPE_CATEGORY, "setting_location")
    return p.select(
        F.lower("p_type").alias("id"),
        F.expr(f"concat('{{', {cat}, ':2:, }} beside {{medium_render}}, {{', {cat}, '}} in {{subject_form}}, {{color_logic}} light')").alias("structure"),
        F.array(F.expr(cat)).alias("required_components"),
        F.lit("").alias("notes"),
    )


# ---- history, state and usage ----------------------------------------------------------------------


def history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.substring(F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", cents)), 1, 16).alias("hash"),
        F.col("event_type").alias("template_id"),
        F.col("ts").alias("created_at"),
        (F.col("value") > 20).alias("favorited"),
    )


HISTORY_SQL = """hist AS (SELECT event_id AS id,
    substr(md5(user_id::VARCHAR || '/' || event_type || '/' || round(value * 100)::BIGINT::VARCHAR), 1, 16) AS hash,
    event_type AS template_id, ts AS created_at, value > 20 AS favorited FROM events)"""

EVENT_CATEGORY = {
    "signup": "light_behavior",
    "error": "spatial_logic",
    "click": "material_substance",
    "view": "medium_render",
    "purchase": "atmosphere_field",
}
EVENT_TEMPLATE = {"signup": "liminal", "error": "specimen", "click": "essence", "view": "ruin_state", "purchase": "free_form"}
WORD_POOL = ["fog", "dust motes", "crt", "charcoal", "silk", "oak", "Rain ", "moiré"]


def user_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as prompts of one slot each: the words are two vector ids, or a keyword for every third event."""
    return prompt_columns(table(spark, sf, "events"), vector_count(spark, sf))


def vector_count(spark: SparkSession, sf: str) -> int:
    return max(1, table(spark, sf, "embeddings").count())


def prompt_columns(e: DataFrame, vectors: int) -> DataFrame:
    """Words are ids of any of the ``vectors`` vectors."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    named = F.get(F.lit(WORD_POOL), F.pmod(cents, F.lit(8)).cast("int"))
    ids = F.array(F.pmod(cents, F.lit(vectors)).cast("string"), F.pmod(cents * 7, F.lit(vectors)).cast("string"))
    words = F.when(F.col("event_id") % 3 == 0, F.array(named)).otherwise(ids)
    return e.select(
        "user_id",
        F.col("event_id").alias("id"),
        F.expr(_case("event_type", EVENT_TEMPLATE, "other")).alias("template_id"),
        F.create_map(F.expr(_case("event_type", EVENT_CATEGORY, "other")), words).alias("components"),
    )


PROMPTS_SQL = f"""prm AS (SELECT user_id, event_id AS id, {_case('event_type', EVENT_TEMPLATE, 'other')} AS template_id,
    {_case('event_type', EVENT_CATEGORY, 'other')} AS category,
    CASE WHEN event_id % 3 = 0 THEN [(['fog', 'dust motes', 'crt', 'charcoal', 'silk', 'oak', 'Rain ', 'moiré'])[(round(value * 100)::BIGINT % 8) + 1]]
    ELSE [(round(value * 100)::BIGINT % nv.n)::VARCHAR, (round(value * 100)::BIGINT * 7 % nv.n)::VARCHAR] END AS words FROM events, (SELECT greatest(1, count(*)) AS n FROM embeddings) nv)"""


def state_sql(defaults: dict[str, list[str]]) -> str:
    """State columns s_<category> after every event, by windows over the user's events."""
    cols = ", ".join(
        f"coalesce(last_value(CASE WHEN category = '{c}' THEN words END IGNORE NULLS) OVER w, ['{v[0]}']) AS s_{c}" for c, v in defaults.items()
    )
    return PROMPTS_SQL + f""",
st AS (SELECT user_id, id, template_id, category, words, {cols} FROM prm
    WINDOW w AS (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as requests: return flag = model, order = request batch, quantities = tokens."""
    x = table(spark, sf, "lineitem")
    tok = lambda e: F.expr(f"cast({e} as bigint)")
    return x.select(
        F.col("l_returnflag").alias("model"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("iteration"),
        F.col("l_linestatus").alias("category"),
        tok("l_quantity * 100").alias("input"),
        tok("l_linenumber * 50").alias("output"),
        tok("round(l_discount * 30000)").alias("cached"),
        tok("l_suppkey % 7").alias("cache_write"),
        tok("l_partkey % 11").alias("cache_read"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F"), F.round(F.col("l_tax"), 2)).alias("reported_cost"),
    )


USAGE_SQL = """use AS (SELECT l_returnflag AS model, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS iteration, l_linestatus AS category,
    (l_quantity * 100)::BIGINT AS input, (l_linenumber * 50)::BIGINT AS output, round(l_discount * 30000)::BIGINT AS cached,
    l_suppkey % 7 AS cache_write, l_partkey % 11 AS cache_read,
    CASE WHEN l_linenumber = 1 AND l_linestatus = 'F' THEN round(l_tax, 2) END AS reported_cost FROM lineitem),
cost AS (SELECT *, coalesce(reported_cost, CASE model
    WHEN 'A' THEN (input * 3.0 + cache_write * 3.75 + cache_read * 0.3 + output * 15.0) / 1e6
    WHEN 'N' THEN (greatest(input - cached, 0) * 2.5 + cached * 0.25 + output * 15.0) / 1e6
    ELSE (input * 0.4 + output * 2.0) / 1e6 END)::DOUBLE AS cost FROM use)"""


def prices(spark: SparkSession) -> DataFrame:
    """Price table: per million tokens, one row per model."""
    return spark.createDataFrame(
        [
            ("A", "split_cache", 3.0, 15.0, 3.75, 0.3, None),
            ("N", "cached_discount", 2.5, 15.0, None, None, 0.25),
            ("R", "flat", 0.4, 2.0, None, None, None),
        ],
        "model string, scheme string, input double, output double, cache_write double, cache_read double, cached_input double",
    )


def caps(spark: SparkSession, sf: str) -> DataFrame:
    """A cap per model: 40 % of what the model spends in total."""
    from wordloom.operators.terms import with_cost

    c = with_cost(usage(spark, sf), prices(spark))
    return c.groupBy("model").agg((F.floor(F.sum("cost") * 40) / 100).alias("cap"))
