"""Queries over files: archives, pools, templates and prompts are written from tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import generation as G
from wordloom.operators import templates as T
from wordloom.operators.cells import similar_pairs as find_pairs
from wordloom.plans import batch as B
from wordloom.session import fresh_path
from wordloom.sources import archives as AR
from wordloom.sources import pools as SP
from wordloom.sources import vectors as SV

from .base import COMPONENTS_SQL, PAIRS, PART_TEMPLATES_SQL, POOLS_SQL, PV, components, part_templates, pool_vectors, pools, query, r6, rounded, table, type_templates
from .prompts import N_PART, generated_sql
from .vectors import THR, _entries

FIRSTS = ("round(a[1], 6) + 0.0 AS visual_first", "round(b[32], 6) + 0.0 AS semantic_last")


def _archive(spark, entries):
    """The entries in npz files, a metadata text beside them, read back in the order of the files' keys."""
    AR.register(spark)
    path = fresh_path(spark, "archive")
    note = spark.createDataFrame([("_metadata_json", None, '{"visual": 32}')], "key string, vector array<double>, text string")
    entries.select("key", "vector", F.lit(None).cast("string").alias("text")).unionByName(note).write.format("npz").mode("append").save(path)
    return spark.read.format("npz").option("bytes", str(1 << 18)).load(path)


@query("archive_file_scan", f"WITH {PV} SELECT category::VARCHAR AS category, 'w/' || word::VARCHAR AS word, {FIRSTS[0]}, {FIRSTS[1]} FROM pv")
def archive_file_scan(spark, sf):
    a = SV.by_category(_archive(spark, _entries(spark, sf)))
    return a.select("category", "word", r6(F.col("visual")[0]).alias("visual_first"), r6(F.col("semantic")[31]).alias("semantic_last"))


@query("archive_file_by_space", f"WITH {PV} SELECT 'n/' || word::VARCHAR AS word, {FIRSTS[0]}, {FIRSTS[1]} FROM pv")
def archive_file_by_space(spark, sf):
    """The other layout of keys: the space first, then the word."""
    v = pool_vectors(spark, sf).withColumn("w", F.concat(F.lit("n/"), F.col("word").cast("string")))
    both = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{s}/"), "w").alias("key"), F.col(c).alias("vector")) for s, c in (("clip", "visual"), ("t5", "semantic"))]))
    a = SV.by_space(_archive(spark, v.select(both.alias("e")).select("e.*")))
    return a.select("word", r6(F.col("visual")[0]).alias("visual_first"), r6(F.col("semantic")[31]).alias("semantic_last"))


@query("archive_file_notes", "SELECT '_metadata_json' AS key, '{\"visual\": 32}' AS text, count(*) * 2 AS vectors FROM embeddings")
def archive_file_notes(spark, sf):
    """What an archive holds beside its vectors."""
    a = _archive(spark, _entries(spark, sf))
    n = a.agg(F.count("vector").alias("vectors"))
    return a.filter("text is not null").select("key", "text").join(n)


@query(
    "pool_file_scan",
    f"""WITH {POOLS_SQL}, {COMPONENTS_SQL.replace('comp AS', 'opp AS')}, o AS (SELECT word AS name, min(opposite) AS opposite FROM opp GROUP BY 1),
t AS (SELECT pool, pools.category, pools.ordinal, pools.word, CASE WHEN ordinal % 3 = 0 THEN 'no ' || pools.word END AS opposite FROM pools)
SELECT pool, category, row_number() OVER (PARTITION BY pool ORDER BY category, ordinal) - 1 AS ordinal, word, opposite FROM t""",
)
def pool_file_scan(spark, sf):
    """Every pool written as a YAML file and all files read back."""
    p = pools(spark, sf).withColumn("opposite", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("no "), "word")))
    folder = fresh_path(spark, "pools")
    SP.write_pool_files(p, folder)
    return SP.read_pools(spark, f"{folder}/*.yaml").select("pool", "category", "ordinal", "word", "opposite")


@query(
    "template_file_scan",
    f"""WITH {PART_TEMPLATES_SQL}, n AS (SELECT template_id, count(*) AS n_slots FROM slots GROUP BY 1)
SELECT id AS template_id, structure, n_slots FROM tem JOIN n ON n.template_id = tem.id""",
)
def template_file_scan(spark, sf):
    """Templates written as YAML files, read back and parsed."""
    folder = fresh_path(spark, "templates")
    SP.write_template_files(part_templates(spark, sf), folder, 4)
    t = SP.read_templates(spark, folder)
    n = T.parse_slots(t).groupBy("template_id").agg(F.count(F.lit(1)).alias("n_slots"))
    return t.select(F.col("id").alias("template_id"), "structure").join(n, "template_id")


@query("emitted_texts", generated_sql(N_PART, "SELECT positive AS value FROM gen"))
def emitted_texts(spark, sf):
    """Positive texts as text files."""
    path = fresh_path(spark, "texts")
    B.emit(_prompts(spark, sf), path)
    return spark.read.text(path)


def _prompts(spark, sf):
    return G.generate(type_templates(spark, sf), components(spark, sf), table(spark, sf, "part").count())


@query("emitted_components", generated_sql(N_PART, "SELECT prompt_no, template_id, parts FROM gen"))
def emitted_components(spark, sf):
    """Whole prompts as JSON Lines, with the words that fill each category."""
    path = fresh_path(spark, "prompts")
    prompts = _prompts(spark, sf)
    B.emit(prompts, path, "json")
    back = spark.read.schema(prompts.schema).json(path)
    parts = F.transform(F.array_sort(F.map_entries("components")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return back.select("prompt_no", "template_id", F.array_join(parts, ";").alias("parts"))


@query(
    "attached_vectors",
    f"WITH {PV}, w AS (SELECT DISTINCT (2 * label * 100 + vec_id)::VARCHAR AS word FROM embeddings) SELECT w.word, round(a[1], 6) + 0.0 AS first FROM w JOIN pv ON pv.word::VARCHAR = w.word",
)
def attached_vectors(spark, sf):
    """Words with the vectors of those that have one."""
    e = table(spark, sf, "embeddings")
    words = e.select((2 * F.col("label") * 100 + F.col("vec_id")).cast("string").alias("word")).distinct()
    have = pool_vectors(spark, sf).select(F.col("word").cast("string").alias("word"), "visual")
    return SV.attach(words, have).select("word", r6(F.col("visual")[0]).alias("first"))


@query(
    "similar_pairs",
    f"WITH {PAIRS} SELECT category, i, j, round(greatest(sv, ss), 6) + 0.0 AS similarity FROM pairs WHERE greatest(sv, ss) > {THR}",
)
def similar_pairs(spark, sf):
    """The pairs above a threshold in either space, through cells of 128 rows."""
    return rounded(find_pairs(pool_vectors(spark, sf), THR, "either_similar", rows=128), "similarity")
