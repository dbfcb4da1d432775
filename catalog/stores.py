"""Queries over versioned tables, indexed history, sketches and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import tables as FT
from wordloom.operators import sketches as SK
from wordloom.session import fresh_path
from wordloom.sources import pools as SP
from wordloom.sources import seen as SE
from wordloom.sources import snapshots as SS

from .base import ORACLE, PART_TEMPLATES_SQL, components, history, part_templates, pools, query, table


@query("snapshot_opposites", ORACLE["updated_opposites"])
def snapshot_opposites(spark, sf):
    """A pool replaced twice by itself with other opposites; readers go from one whole version to the next."""
    path = fresh_path(spark, "pool")
    SS.replace(spark, components(spark, sf), path)
    w = Window.partitionBy("category").orderBy("ordinal")
    for _ in range(2):
        c = SS.read_version(spark, path)
        pairs = c.select("category", "word", F.lead("word").over(w).alias("opposite")).filter(F.col("word").startswith("red "))
        SS.replace(spark, SP.update_opposites(c, pairs.filter("opposite is not null")), path)
    return SS.read_version(spark, path).select("category", "word", "opposite")


@query("indexed_history", ORACLE["appended_history"])
def indexed_history(spark, sf):
    """Two batches, each appended twice, to buckets with Bloom filters; then all parts merged."""
    path = fresh_path(spark, "seen")
    h = history(spark, sf)
    half = int(h.agg(F.max("id")).first()[0]) // 2
    for part in (h.filter(F.col("id") <= half), h.filter(F.col("id") > half)) * 2:
        SE.append_seen(part, path, buckets=16)
    SE.merged(spark, path, buckets=16)
    return SE.read_seen(spark, path).select("hash", "id", "template_id", "favorited")


@query("pool_overlap_sketched", f"SELECT *, 0.0::DOUBLE AS bound FROM ({ORACLE['pool_overlap']})")
def pool_overlap_sketched(spark, sf):
    """Pools here fit their sketches, so the estimates are the exact numbers."""
    return SK.overlap_sketched(SK.pool_sketches(pools(spark, sf)))


@query("slot_parse_sql", f'WITH {PART_TEMPLATES_SQL} SELECT template_id, slot_no::INTEGER AS slot_no, category, "count", separator, slot FROM slots')
def slot_parse_sql(spark, sf):
    """Slots by the table function, from SQL."""
    FT.register(spark)
    return spark.sql(
        "SELECT t.id AS template_id, s.* FROM {t} t, LATERAL slot_parts(t.structure) s", t=part_templates(spark, sf).select("id", "structure")
    )


@query(
    "unranked_draws",
    """WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1),
r AS (SELECT size, row_number() OVER w - 1 AS place, coalesce(product(size) OVER (ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)::BIGINT AS below FROM s WINDOW w AS (ORDER BY p_type))
SELECT p_partkey, place::INTEGER AS place, (p_partkey * 7919 // below) % size AS digit FROM part CROSS JOIN r""",
)
def unranked_draws(spark, sf):
    """Numbered draws of one part of each type, unranked from SQL."""
    FT.register(spark)
    return spark.sql(
        """WITH s AS (SELECT transform(array_sort(collect_list(struct(p_type, n))), x -> x.n) AS sizes FROM (SELECT p_type, count(*) AS n FROM {p} GROUP BY 1))
SELECT p.p_partkey, u.place, u.digit FROM (SELECT p_partkey, (SELECT sizes FROM s) AS sizes FROM {p}) p, LATERAL unrank(p.p_partkey * 7919, p.sizes) u""",
        p=table(spark, sf, "part").select("p_partkey", "p_type"),
    )
