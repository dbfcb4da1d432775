"""Queries over vectors: diversity, centroids, selection, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import centroids as C
from wordloom.operators import diversity as D
from wordloom.operators import moments as M
from wordloom.operators import pairs as PR
from wordloom.operators import probes as PB
from wordloom.operators import selection as S
from wordloom.operators.nearest import nearest
from wordloom.plans.select_pools import select_pools
from wordloom.session import fresh_path
from wordloom.sources import vectors as SV

from .base import ALLPAIRS, PAIRS, PV, bands, centroid_sql, closest_sql, pool_vectors, query, r6, rounded, table

THR = 0.5  # the reference threshold of 0.85 finds nothing in these vectors

# ---- pair statistics -------------------------------------------------------------------------------


def _diversity_sql(sim: str) -> str:
    return f"""WITH {PAIRS}, q AS (SELECT *, {sim} AS s FROM pairs), n AS (SELECT category, count(*) AS c FROM pv GROUP BY 1)
SELECT n.category, n.c AS "count", round(avg(s), 6) + 0.0 AS mean_similarity, round(min(s), 6) + 0.0 AS min_similarity,
    round(max(s), 6) + 0.0 AS max_similarity, round(stddev_pop(s), 6) + 0.0 AS std_similarity,
    arg_max(i, s) AS similar_a, arg_max(j, s) AS similar_b, arg_min(i, s) AS distant_a, arg_min(j, s) AS distant_b,
    count(*) FILTER (s > {THR}) AS redundant_pairs
FROM n LEFT JOIN q USING (category) GROUP BY 1, 2"""


STATS = ("mean_similarity", "min_similarity", "max_similarity", "std_similarity")


@query("diversity_joint", _diversity_sql("0.5 * sv + 0.5 * ss"))
def diversity_joint(spark, sf):
    return rounded(D.diversity(pool_vectors(spark, sf), "joint", 0.5, THR), *STATS)


@query("diversity_either_similar", _diversity_sql("greatest(sv, ss)"))
def diversity_either_similar(spark, sf):
    return rounded(D.diversity(pool_vectors(spark, sf), "either_similar", threshold=THR), *STATS)


@query("diversity_either_distinct", _diversity_sql("least(sv, ss)"))
def diversity_either_distinct(spark, sf):
    return rounded(D.diversity(pool_vectors(spark, sf), "either_distinct", threshold=THR), *STATS)


@query("diversity_semantic", _diversity_sql("ss"))
def diversity_semantic(spark, sf):
    return rounded(D.diversity(pool_vectors(spark, sf), "semantic", threshold=THR), *STATS)


@query(
    "category_spread",
    f"""WITH {PAIRS} SELECT category, count(*) AS pairs, round(avg(sv), 6) + 0.0 AS mean, round(min(sv), 6) + 0.0 AS min,
    round(max(sv), 6) + 0.0 AS max, round(max(sv) - min(sv), 6) + 0.0 AS range, round(stddev_pop(sv), 6) + 0.0 AS std,
    count(*) FILTER (sv > {THR}) AS redundant_pairs FROM pairs GROUP BY 1""",
)
def category_spread(spark, sf):
    s = D.spread_or_zero(pool_vectors(spark, sf), "visual", ["category"], THR)
    pairs = (F.col("count") * (F.col("count") - 1) / 2).cast("bigint").alias("pairs")
    return rounded(s.select("category", pairs, "mean", "min", "max", "range", "std", "redundant_pairs"), "mean", "min", "max", "range", "std")


@query(
    "space_weights",
    f"""WITH {PAIRS}, s AS (SELECT category, avg(sv) AS vm, stddev_pop(sv) AS vs, max(sv) - min(sv) AS vr, var_pop(sv) AS vv,
    avg(ss) AS sm, stddev_pop(ss) AS sd, max(ss) - min(ss) AS sr, var_pop(ss) AS sv2 FROM pairs GROUP BY 1),
t AS (SELECT *, CASE WHEN vv + sv2 > 0 THEN vv / (vv + sv2) ELSE 0.5 END AS al FROM s)
SELECT category, round(vm, 6) + 0.0 AS visual_mean, round(vs, 6) + 0.0 AS visual_std, round(vr, 6) + 0.0 AS visual_range, round(vv, 6) + 0.0 AS visual_var,
    round(sm, 6) + 0.0 AS semantic_mean, round(sd, 6) + 0.0 AS semantic_std, round(sr, 6) + 0.0 AS semantic_range, round(sv2, 6) + 0.0 AS semantic_var,
    round(al, 3) + 0.0 AS alpha, CASE WHEN al > 0.55 THEN 'visual' WHEN al < 0.45 THEN 'semantic' ELSE 'balanced' END AS winner FROM t""",
)
def space_weights(spark, sf):
    names = [f"{s}_{x}" for s in ("visual", "semantic") for x in ("mean", "std", "range", "var")]
    return rounded(D.space_weights(pool_vectors(spark, sf)), *names, "alpha")


@query(
    "space_weight_summary",
    f"""WITH {PAIRS}, t AS (SELECT category, round(var_pop(sv) / (var_pop(sv) + var_pop(ss)), 3) AS al FROM pairs GROUP BY 1)
SELECT round(avg(al), 6) + 0.0 AS mean_alpha, round(min(al), 6) + 0.0 AS min_alpha, round(max(al), 6) + 0.0 AS max_alpha,
    count(*) FILTER (al > 0.55) AS visual_dominant, count(*) FILTER (al < 0.45) AS semantic_dominant,
    count(*) FILTER (al BETWEEN 0.45 AND 0.55) AS balanced FROM t""",
)
def space_weight_summary(spark, sf):
    return rounded(D.space_weight_summary(D.space_weights(pool_vectors(spark, sf))), "mean_alpha", "min_alpha", "max_alpha")


@query(
    "space_correlation",
    f"""WITH {PAIRS} SELECT category, count(*) AS pairs, round(avg(sv), 6) + 0.0 AS visual_mean, round(avg(ss), 6) + 0.0 AS semantic_mean,
    round(corr(sv, ss), 6) + 0.0 AS pearson_r FROM pairs GROUP BY ROLLUP (category)""",
)
def space_correlation(spark, sf):
    return rounded(D.space_correlation(pool_vectors(spark, sf)), "visual_mean", "semantic_mean", "pearson_r")


@query(
    "spread_by_moments",
    f"WITH {PAIRS} SELECT category, round(stddev_pop(sv), 6) + 0.0 AS visual_std, round(stddev_pop(ss), 6) + 0.0 AS semantic_std FROM pairs GROUP BY 1",
)
def spread_by_moments(spark, sf):
    return rounded(D.spread_by_moments(pool_vectors(spark, sf)), "visual_std", "semantic_std")


@query(
    "redundancy_agreement",
    f"""WITH {PAIRS} SELECT category, count(*) FILTER (sv > 0.3 AND ss > 0.3) AS "both", count(*) FILTER (sv > 0.3 OR ss > 0.3) AS either,
    round(count(*) FILTER (sv > 0.3 AND ss > 0.3) / greatest(count(*) FILTER (sv > 0.3 OR ss > 0.3), 1), 6) + 0.0 AS jaccard FROM pairs GROUP BY 1""",
)
def redundancy_agreement(spark, sf):
    return rounded(D.redundancy_agreement(pool_vectors(spark, sf), 0.3), "jaccard")


def _gap_sql(order: str) -> str:
    return f"""WITH {ALLPAIRS} SELECT i AS word_a, j AS word_b, round(sv, 6) + 0.0 AS sim_visual, round(ss, 6) + 0.0 AS sim_semantic,
    round(sv - ss, 6) + 0.0 AS gap FROM pairs ORDER BY sv - ss {order}, i, j LIMIT 10"""


@query("pair_disagreement_visual", _gap_sql("DESC"))
def pair_disagreement_visual(spark, sf):
    return rounded(D.pair_disagreement(pool_vectors(spark, sf), 10, True), "sim_visual", "sim_semantic", "gap")


@query("pair_disagreement_semantic", _gap_sql("ASC"))
def pair_disagreement_semantic(spark, sf):
    return rounded(D.pair_disagreement(pool_vectors(spark, sf), 10, False), "sim_visual", "sim_semantic", "gap")


@query(
    "archive_metadata",
    f"""WITH {PV} SELECT 'visual' AS space, 'encoder_a' AS model, max(len(a)) AS dimension, count(a) AS words, count(*) AS total FROM pv
UNION ALL SELECT 'semantic', 'encoder_b', max(len(b)), count(b), count(*) FROM pv""",
)
def archive_metadata(spark, sf):
    """What is written beside an archive's vectors."""
    meta = SV.write_archive(pool_vectors(spark, sf), fresh_path(spark, "archive"), {"visual": "encoder_a", "semantic": "encoder_b"})
    return meta.select("space", "model", F.col("dimension").cast("bigint").alias("dimension"), "words", "total")


@query(
    "model_stats",
    f"""WITH {PAIRS}, l AS (SELECT category, 'encoder_a' AS model, sv AS s FROM pairs UNION ALL SELECT category, 'encoder_b', ss FROM pairs UNION ALL SELECT category, 'encoder_c', sv FROM pairs)
SELECT model, category, round(avg(s), 4) + 0.0 AS mean, round(min(s), 4) + 0.0 AS min, round(max(s), 4) + 0.0 AS max,
    round(stddev_pop(s), 4) + 0.0 AS std, count(*) FILTER (s > {THR}) AS redundant_pairs FROM l GROUP BY ALL""",
)
def model_stats(spark, sf):
    three = {"encoder_a": "visual", "encoder_b": "semantic", "encoder_c": "visual"}
    s = D.by_model(D.models_as_rows(pool_vectors(spark, sf), three), THR)
    return s.withColumns({c: F.col(c) + F.lit(0.0) for c in ("mean", "min", "max", "std")})


@query(
    "model_pivot",
    f"""WITH {PAIRS} SELECT category, round(avg(sv), 4) + 0.0 AS encoder_a, round(avg(ss), 4) + 0.0 AS encoder_b FROM pairs GROUP BY 1""",
)
def model_pivot(spark, sf):
    stats = D.by_model(D.models_as_rows(pool_vectors(spark, sf), {"encoder_a": "visual", "encoder_b": "semantic"}), THR)
    p = D.model_pivot(stats, ["encoder_a", "encoder_b"])
    return p.withColumns({c: F.col(c) + F.lit(0.0) for c in ("encoder_a", "encoder_b")})


@query(
    "cross_similarity",
    f"""WITH {PV}, q AS (SELECT list_dot_product(x.a, y.a) AS s FROM pv x JOIN pv y ON x.category < 5 AND y.category >= 5)
SELECT round(avg(s), 6) + 0.0 AS mean, round(min(s), 6) + 0.0 AS min, round(max(s), 6) + 0.0 AS max FROM q""",
)
def cross_similarity(spark, sf):
    """Two sets that together are the whole table."""
    v = pool_vectors(spark, sf)
    return rounded(D.cross_spread(v.filter("category < 5"), v.filter("category >= 5")), "mean", "min", "max")


@query("principal_axes")
def principal_axes(spark, sf):
    p = D.principal_axes(pool_vectors(spark, sf), 2)
    return rounded(p.select("word", "category", "axis_1", "axis_2", "explained_1", "explained_2"), "axis_1", "axis_2", "explained_1", "explained_2")


# ---- centroids -------------------------------------------------------------------------------------


@query(
    "centroids",
    f"""WITH {centroid_sql()}, f AS (SELECT category, unnest(a) AS visual, unnest(b) AS semantic, generate_subscripts(a, 1) - 1 AS pos FROM cen)
SELECT category, pos, round(visual, 6) + 0.0 AS visual, round(semantic, 6) + 0.0 AS semantic FROM f""",
)
def centroids(spark, sf):
    c = M.centroids(pool_vectors(spark, sf), ["category"])
    both = F.arrays_zip("visual", "semantic")
    return rounded(c.select("category", F.posexplode(both).alias("pos", "z")).select("category", F.col("pos").cast("bigint").alias("pos"), "z.visual", "z.semantic"), "visual", "semantic")


CONTAMINATION = f"""WITH {closest_sql()} SELECT word, category AS assigned, says_j AS closest, round(own_j, 6) + 0.0 AS sim_assigned,
    round(best_j, 6) + 0.0 AS sim_closest, round(best_j - own_j, 6) + 0.0 AS delta FROM best WHERE says_j <> category"""


@query("contamination", CONTAMINATION)
def contamination(spark, sf):
    return rounded(C.contamination(pool_vectors(spark, sf)).drop("ordinal"), "sim_assigned", "sim_closest", "delta")


@query("contamination_tiled", CONTAMINATION)
def contamination_tiled(spark, sf):
    """The form for centroids too large to ship."""
    return rounded(C.contamination(pool_vectors(spark, sf), broadcast_bytes=0, rows=256).drop("ordinal"), "sim_assigned", "sim_closest", "delta")


@query(
    "contamination_top",
    f"""WITH {closest_sql()} SELECT word, category AS assigned, says_j AS closest, round(best_j - own_j, 6) + 0.0 AS delta
FROM best WHERE says_j <> category ORDER BY best_j - own_j DESC, ordinal LIMIT 15""",
)
def contamination_top(spark, sf):
    top = C.worst_contamination(C.contamination(pool_vectors(spark, sf)), 15)
    return rounded(top.select("word", "assigned", "closest", "delta"), "delta")


MOVES = f"""{closest_sql()}, mv AS (SELECT word, ordinal, category AS from_category, says_v AS to_category, best_v - own_v AS dv, best_s - own_s AS ds FROM best
    WHERE says_v <> category AND says_s = says_v AND best_v - own_v > 0.01 AND best_s - own_s > 0.01)"""


@query(
    "reallocation_moves",
    f"WITH {MOVES} SELECT word, from_category, to_category, round(dv, 6) + 0.0 AS delta_visual, round(ds, 6) + 0.0 AS delta_semantic FROM mv",
)
def reallocation_moves(spark, sf):
    return rounded(C.proposed_moves(pool_vectors(spark, sf)).drop("ordinal"), "delta_visual", "delta_semantic")


@query(
    "reallocation_top_moves",
    f"WITH {MOVES} SELECT word, from_category, to_category, round(dv + ds, 6) + 0.0 AS delta FROM mv ORDER BY dv + ds DESC, ordinal LIMIT 5",
)
def reallocation_top_moves(spark, sf):
    top = C.largest_moves(C.proposed_moves(pool_vectors(spark, sf)))
    return top.select("word", "from_category", "to_category", r6(F.col("delta_visual") + F.col("delta_semantic")).alias("delta"))


@query(
    "reallocated_pool",
    f"""WITH {MOVES}, m AS (SELECT max(ordinal) AS m FROM pv)
SELECT coalesce(mv.to_category, pv.category) AS category, CASE WHEN mv.word IS NULL THEN pv.ordinal ELSE pv.ordinal + m.m + 1 END AS ordinal,
    pv.word, mv.word IS NOT NULL AS moved FROM pv LEFT JOIN mv ON pv.ordinal = mv.ordinal CROSS JOIN m""",
)
def reallocated_pool(spark, sf):
    return C.reallocate(pool_vectors(spark, sf)).select("category", "ordinal", "word", "moved")


CONF = f"""{closest_sql("pool")}, conf AS (SELECT *, CASE
    WHEN (own_v > best_v * 0.85 OR says_v = category) AND (own_s > best_s * 0.85 OR says_s = category) THEN 'rock_solid'
    WHEN own_v > best_v * 0.85 OR says_v = category THEN 'visual_anchor'
    WHEN own_s > best_s * 0.85 OR says_s = category THEN 'semantic_anchor' ELSE 'weak' END AS quadrant FROM best)"""


@query(
    "word_confidence",
    f"""WITH {CONF} SELECT pool, category, word, round(own_v, 6) + 0.0 AS visual_confidence, round(own_s, 6) + 0.0 AS semantic_confidence,
    says_v AS visual_says, says_s AS semantic_says, quadrant FROM conf""",
)
def word_confidence(spark, sf):
    c = C.word_confidence(bands(pool_vectors(spark, sf)))
    return rounded(c.select("pool", "category", "word", "visual_confidence", "semantic_confidence", "visual_says", "semantic_says", "quadrant"), "visual_confidence", "semantic_confidence")


@query(
    "confidence_by_category",
    f"""WITH {CONF} SELECT pool, category, count(*) AS "count", round(avg(own_v), 6) + 0.0 AS visual_mean, round(stddev_pop(own_v), 6) + 0.0 AS visual_std,
    round(min(own_v), 6) + 0.0 AS visual_min, round(avg(own_s), 6) + 0.0 AS semantic_mean, round(stddev_pop(own_s), 6) + 0.0 AS semantic_std,
    round(min(own_s), 6) + 0.0 AS semantic_min FROM conf GROUP BY ALL""",
)
def confidence_by_category(spark, sf):
    c = C.confidence_by_category(C.word_confidence(bands(pool_vectors(spark, sf))))
    return rounded(c, *[f"{s}_{x}" for s in ("visual", "semantic") for x in ("mean", "std", "min")])


@query(
    "quadrant_shares",
    f"""WITH {CONF}, q AS (SELECT unnest(['rock_solid', 'visual_anchor', 'semantic_anchor', 'weak']) AS quadrant),
p AS (SELECT pool, count(*) AS n FROM conf GROUP BY 1), g AS (SELECT pool, quadrant, count(*) AS c FROM conf GROUP BY ALL)
SELECT p.pool, q.quadrant, coalesce(c, 0) AS "count", round(coalesce(c, 0) / n * 100, 1) + 0.0 AS pct
FROM p CROSS JOIN q LEFT JOIN g ON g.pool = p.pool AND g.quadrant = q.quadrant""",
)
def quadrant_shares(spark, sf):
    return C.quadrant_shares(C.word_confidence(bands(pool_vectors(spark, sf))))


@query(
    "flag_counts",
    f"""WITH {CONF} SELECT pool, count(*) FILTER (says_v <> category AND says_s <> category) AS both_disagree,
    count(*) FILTER (says_v <> category AND says_s = category) AS visual_only,
    count(*) FILTER (says_v = category AND says_s <> category) AS semantic_only FROM conf GROUP BY 1""",
)
def flag_counts(spark, sf):
    return C.flag_counts(C.word_confidence(bands(pool_vectors(spark, sf))))


@query(
    "weakest_flags",
    f"""WITH {CONF}, f AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY own_v + own_s, ordinal) AS rank FROM conf
    WHERE says_v <> category AND says_s <> category)
SELECT pool, rank::INTEGER AS rank, word, category AS assigned, says_v AS visual_says, says_s AS semantic_says, round(own_v + own_s, 6) + 0.0 AS confidence FROM f WHERE rank <= 15""",
)
def weakest_flags(spark, sf):
    f = C.weakest_flags(C.word_confidence(bands(pool_vectors(spark, sf))))
    return f.select("pool", "rank", "word", F.col("category").alias("assigned"), "visual_says", "semantic_says", r6(F.col("visual_confidence") + F.col("semantic_confidence")).alias("confidence"))


@query(
    "confidence_by_pool",
    f"""WITH {CONF} SELECT category, round(avg(own_v) FILTER (pool = 'band_0'), 6) + 0.0 AS band_0, round(avg(own_v) FILTER (pool = 'band_1'), 6) + 0.0 AS band_1,
    round(avg(own_v) FILTER (pool = 'band_2'), 6) + 0.0 AS band_2 FROM conf GROUP BY 1""",
)
def confidence_by_pool(spark, sf):
    c = C.confidence_by_category(C.word_confidence(bands(pool_vectors(spark, sf))))
    names = ["band_0", "band_1", "band_2"]
    return rounded(C.confidence_pivot(c, names, "visual_mean"), *names)


@query(
    "quadrants_by_pool",
    f"""WITH {CONF}, q AS (SELECT unnest(['rock_solid', 'visual_anchor', 'semantic_anchor', 'weak']) AS quadrant),
n AS (SELECT pool, count(*) AS n FROM conf GROUP BY 1), g AS (SELECT q.quadrant, n.pool, n.n, count(c.word) AS c FROM q CROSS JOIN n LEFT JOIN conf c ON c.quadrant = q.quadrant AND c.pool = n.pool GROUP BY ALL)
SELECT quadrant, max(round(c / n * 100, 1)) FILTER (pool = 'band_0') + 0.0 AS band_0, max(round(c / n * 100, 1)) FILTER (pool = 'band_1') + 0.0 AS band_1,
    max(round(c / n * 100, 1)) FILTER (pool = 'band_2') + 0.0 AS band_2 FROM g GROUP BY 1""",
)
def quadrants_by_pool(spark, sf):
    return C.quadrant_pivot(C.quadrant_shares(C.word_confidence(bands(pool_vectors(spark, sf)))), ["band_0", "band_1", "band_2"])


CPAIRS = f"""{centroid_sql()}, cp AS (SELECT x.category AS a, y.category AS b, list_dot_product(x.a, y.a) AS v, list_dot_product(x.b, y.b) AS s FROM cen x, cen y)"""


@query("centroid_pairs", f"WITH {CPAIRS} SELECT a, b, round(v, 6) + 0.0 AS sim_visual, round(s, 6) + 0.0 AS sim_semantic FROM cp")
def centroid_pairs(spark, sf):
    return rounded(C.centroid_pairs(pool_vectors(spark, sf)), "sim_visual", "sim_semantic")


@query(
    "centroid_summary",
    f"""WITH {CPAIRS}, r AS (SELECT round(v, 4) AS v FROM cp WHERE a < b)
SELECT round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(max(v) - min(v), 6) + 0.0 AS range FROM r""",
)
def centroid_summary(spark, sf):
    return rounded(C.centroid_summary(pool_vectors(spark, sf)), "mean", "min", "max", "range")


def _extreme_sql(order: str) -> str:
    return f"""WITH {CPAIRS} SELECT a, b, round(v, 6) + 0.0 AS sim_visual, round(s, 6) + 0.0 AS sim_semantic FROM cp WHERE a < b ORDER BY v + s {order}, a, b LIMIT 10"""


@query("category_closest", _extreme_sql("DESC"))
def category_closest(spark, sf):
    return rounded(C.category_extremes(pool_vectors(spark, sf), 10, True), "sim_visual", "sim_semantic")


@query("category_distant", _extreme_sql("ASC"))
def category_distant(spark, sf):
    return rounded(C.category_extremes(pool_vectors(spark, sf), 10, False), "sim_visual", "sim_semantic")


@query(
    "category_disagreement",
    f"""WITH {CPAIRS} SELECT a, b, round(v, 6) + 0.0 AS sim_visual, round(s, 6) + 0.0 AS sim_semantic, round(abs(v - s), 6) + 0.0 AS delta,
    CASE WHEN v > s THEN 'visual closer' ELSE 'semantic closer' END AS direction FROM cp WHERE a < b ORDER BY abs(v - s) DESC, a, b LIMIT 15""",
)
def category_disagreement(spark, sf):
    return rounded(C.space_disagreement(pool_vectors(spark, sf), 15), "sim_visual", "sim_semantic", "delta")


@query(
    "category_isolation",
    f"WITH {CPAIRS} SELECT a AS category, round(avg(v), 6) + 0.0 AS visual_avg, round(avg(s), 6) + 0.0 AS semantic_avg FROM cp WHERE a <> b GROUP BY 1",
)
def category_isolation(spark, sf):
    return rounded(C.isolation(pool_vectors(spark, sf)), "visual_avg", "semantic_avg")


# ---- greedy selection ------------------------------------------------------------------------------

# sequential scan per category: a word is kept when no kept earlier word is too similar
KEPT = f"""{PAIRS}, nb AS (SELECT category, j AS ordinal, list(i) AS near FROM pairs WHERE greatest(sv, ss) > {THR} GROUP BY ALL),
ord AS (SELECT pv.category, pv.ordinal, coalesce(near, []) AS near, row_number() OVER (PARTITION BY pv.category ORDER BY pv.ordinal) AS p
    FROM pv LEFT JOIN nb ON nb.category = pv.category AND nb.ordinal = pv.ordinal),
scan AS (SELECT category, 0::BIGINT AS p, []::BIGINT[] AS kept FROM (SELECT DISTINCT category FROM pv)
    UNION ALL SELECT s.category, o.p, CASE WHEN list_has_any(s.kept, o.near) THEN s.kept ELSE list_append(s.kept, o.ordinal) END
    FROM scan s JOIN ord o ON o.category = s.category AND o.p = s.p + 1),
last AS (SELECT category, arg_max(kept, p) AS kept FROM scan GROUP BY 1)"""


REDUNDANCY = (
    f"WITH RECURSIVE {KEPT} SELECT pv.category, pv.ordinal, pv.word, list_contains(last.kept, pv.ordinal) AS kept FROM pv JOIN last USING (category)"
)


@query("redundancy_filter", REDUNDANCY)
def redundancy_filter(spark, sf):
    return S.mark_redundant(pool_vectors(spark, sf), THR).select("category", "ordinal", "word", "kept")


@query("redundancy_filter_rounds", REDUNDANCY)
def redundancy_filter_rounds(spark, sf):
    """The form for groups beyond one task."""
    return S.mark_redundant(pool_vectors(spark, sf), THR, small=8, rows=64).select("category", "ordinal", "word", "kept")


def _walk_sql(sim: str, k: int, start: str, fold: str = "min") -> str:
    """Farthest-point walk: ``start`` gives (category, chosen, n)."""
    return f"""sym AS (SELECT category, i, j, {sim} AS s FROM pairs UNION ALL SELECT category, j, i, {sim} FROM pairs),
walk AS ({start} UNION ALL
    SELECT category, list_append(chosen, w), n + 1, cur FROM (
        SELECT category, chosen, n, arg_min(w, {{'a': cur, 'b': w}}) AS w, min(cur) AS cur FROM (
            SELECT walk.category, walk.chosen, walk.n, t.j AS w, {fold}(t.s) AS cur FROM walk JOIN sym t
            ON t.category = walk.category AND list_contains(walk.chosen, t.i) AND NOT list_contains(walk.chosen, t.j)
            WHERE walk.n < {k} GROUP BY ALL) GROUP BY ALL))"""


FIRST = "SELECT category, [min(ordinal)] AS chosen, 1 AS n, NULL::DOUBLE AS cur FROM pv GROUP BY 1"
APART = "SELECT category, [arg_min(i, {'a': s, 'b': i, 'c': j}), arg_min(j, {'a': s, 'b': i, 'c': j})] AS chosen, 2 AS n, NULL::DOUBLE AS cur FROM sym GROUP BY 1"


DIVERSE = (
    f"""WITH RECURSIVE {PAIRS}, {_walk_sql('least(sv, ss)', 12, FIRST)}
SELECT category, n AS rank, chosen[n] AS word, round(cur, 6) + 0.0 AS similarity FROM walk"""
)


@query("diverse_words", DIVERSE)
def diverse_words(spark, sf):
    return rounded(S.diverse_words(pool_vectors(spark, sf), 12), "similarity").select("category", "rank", "word", "similarity")


@query("diverse_words_rounds", DIVERSE)
def diverse_words_rounds(spark, sf):
    """The form for groups beyond one task."""
    d = S.diverse_words(pool_vectors(spark, sf), 12, small=8, rows=64)
    return rounded(d, "similarity").select("category", "rank", "word", "similarity")


@query(
    "diverse_words_max",
    f"""WITH RECURSIVE {PAIRS}, {_walk_sql('least(sv, ss)', 12, FIRST, 'max')}
SELECT category, n AS rank, chosen[n] AS word, round(cur, 6) + 0.0 AS similarity FROM walk""",
)
def diverse_words_max(spark, sf):
    return rounded(S.diverse_words(pool_vectors(spark, sf), 12, linkage="max"), "similarity").select("category", "rank", "word", "similarity")


@query(
    "elbow",
    f"""WITH RECURSIVE {PAIRS}, {_walk_sql('least(sv, ss)', 16, APART)},
d AS (SELECT category, n, 1 - cur AS d, lead(1 - cur) OVER (PARTITION BY category ORDER BY n) AS nx FROM walk WHERE n > 2)
SELECT category, arg_min(n, {{'a': nx - d, 'b': n}})::BIGINT AS elbow_k FROM d WHERE nx IS NOT NULL GROUP BY 1""",
)
def elbow(spark, sf):
    return S.elbow(pool_vectors(spark, sf), 16)


OPP = f"""{PAIRS}, step AS (SELECT category, []::BIGINT[] AS used, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS s FROM (SELECT DISTINCT category FROM pv)
    UNION ALL SELECT category, list_concat(used, [b.i, b.j]), b.i, b.j, b.s FROM (
        SELECT step.category, step.used, arg_min({{'i': p.i, 'j': p.j, 's': p.ss}}, {{'a': p.ss, 'b': p.i, 'c': p.j}}) AS b FROM step JOIN pairs p
        ON p.category = step.category AND NOT list_contains(step.used, p.i) AND NOT list_contains(step.used, p.j) GROUP BY ALL)),
mates AS (SELECT category, i AS word, j AS opposite, s FROM step WHERE i IS NOT NULL UNION ALL SELECT category, j, i, s FROM step WHERE i IS NOT NULL),
lone AS (SELECT pv.category, pv.word, arg_min(CASE WHEN p.i = pv.word THEN p.j ELSE p.i END, p.ss) AS opposite, min(p.ss) AS s FROM pv
    JOIN pairs p ON p.category = pv.category AND (p.i = pv.word OR p.j = pv.word)
    WHERE NOT EXISTS (SELECT 1 FROM mates m WHERE m.category = pv.category AND m.word = pv.word) GROUP BY ALL)"""


OPPOSITE = f"WITH RECURSIVE {OPP} SELECT category, word, opposite, round(s, 6) + 0.0 AS similarity FROM (SELECT * FROM mates UNION ALL SELECT * FROM lone)"


@query("opposite_pairs", OPPOSITE)
def opposite_pairs(spark, sf):
    return rounded(S.opposite_pairs(pool_vectors(spark, sf)).drop("ordinal"), "similarity")


@query("opposite_pairs_rounds", OPPOSITE)
def opposite_pairs_rounds(spark, sf):
    """The form for groups beyond one task."""
    return rounded(S.opposite_pairs(pool_vectors(spark, sf), small=8, rows=64).drop("ordinal"), "similarity")


@query(
    "distant_pairs",
    f"""WITH RECURSIVE {ALLPAIRS}, cross_ AS (SELECT * FROM pairs WHERE ci <> cj),
step AS (SELECT []::BIGINT[] AS used, 0 AS n, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::INTEGER AS ci, NULL::INTEGER AS cj, NULL::DOUBLE AS s
    UNION ALL SELECT list_concat(used, [b.i, b.j]), n + 1, b.i, b.j, b.ci, b.cj, b.s FROM (
        SELECT step.used, step.n, arg_min({{'i': p.i, 'j': p.j, 'ci': p.ci, 'cj': p.cj, 's': p.ss}}, {{'a': p.ss, 'b': p.i, 'c': p.j}}) AS b FROM step JOIN cross_ p
        ON NOT list_contains(step.used, p.i) AND NOT list_contains(step.used, p.j) WHERE step.n < 10 GROUP BY ALL))
SELECT i AS word_a, j AS word_b, ci AS category_a, cj AS category_b, round(s, 6) + 0.0 AS similarity, n AS rank FROM step WHERE n > 0""",
)
def distant_pairs(spark, sf):
    return rounded(S.distant_pairs(pool_vectors(spark, sf), 10), "similarity")


NEGATED = "(0, 2, 4, 6, 8)"
# the whole pipeline: agreed moves, sequential filter, farthest-point walk, greedy pairing by rank
GATED = f"""{MOVES}, top_ AS (SELECT max(ordinal) AS m FROM pv),
p1 AS (SELECT coalesce(mv.to_category, pv.category) AS category, CASE WHEN mv.word IS NULL THEN pv.ordinal ELSE pv.ordinal + top_.m + 1 END AS ordinal, pv.word, pv.a, pv.b
    FROM pv LEFT JOIN mv ON pv.ordinal = mv.ordinal CROSS JOIN top_),
q1 AS (SELECT x.category, x.ordinal AS i, y.ordinal AS j, list_dot_product(x.a, y.a) AS sv, list_dot_product(x.b, y.b) AS ss FROM p1 x JOIN p1 y ON x.category = y.category AND x.ordinal < y.ordinal),
nb AS (SELECT category, j AS ordinal, list(i) AS near FROM q1 WHERE greatest(sv, ss) > {THR} GROUP BY ALL),
ord AS (SELECT p1.category, p1.ordinal, coalesce(near, []) AS near, row_number() OVER (PARTITION BY p1.category ORDER BY p1.ordinal) AS p
    FROM p1 LEFT JOIN nb ON nb.category = p1.category AND nb.ordinal = p1.ordinal),
scan AS (SELECT category, 0::BIGINT AS p, []::BIGINT[] AS kept FROM (SELECT DISTINCT category FROM p1)
    UNION ALL SELECT s.category, o.p, CASE WHEN list_has_any(s.kept, o.near) THEN s.kept ELSE list_append(s.kept, o.ordinal) END
    FROM scan s JOIN ord o ON o.category = s.category AND o.p = s.p + 1),
kept AS (SELECT category, arg_max(kept, p) AS kept FROM scan GROUP BY 1),
pairs AS (SELECT q1.* FROM q1 JOIN kept ON kept.category = q1.category AND list_contains(kept.kept, q1.i) AND list_contains(kept.kept, q1.j)),
{_walk_sql('least(sv, ss)', 12, "SELECT category, [kept[1]] AS chosen, 1 AS n, NULL::DOUBLE AS cur FROM kept")},
pick AS (SELECT w.category, w.n AS rank, w.chosen[w.n] AS ordinal, p1.word, p1.a, p1.b FROM walk w JOIN p1 ON p1.category = w.category AND p1.ordinal = w.chosen[w.n]),
sp AS (SELECT x.category, x.rank AS i, y.rank AS j, list_dot_product(x.b, y.b) AS ss, least(list_dot_product(x.a, y.a), list_dot_product(x.b, y.b)) AS sd, x.word AS wi, y.word AS wj
    FROM pick x JOIN pick y ON x.category = y.category AND x.rank < y.rank),
step AS (SELECT category, []::INTEGER[] AS used, NULL::INTEGER AS i, NULL::INTEGER AS j FROM (SELECT DISTINCT category FROM pick WHERE category IN {NEGATED})
    UNION ALL SELECT category, list_concat(used, [b.i, b.j]), b.i, b.j FROM (
        SELECT step.category, step.used, arg_min({{'i': p.i, 'j': p.j}}, {{'a': p.ss, 'b': p.i, 'c': p.j}}) AS b FROM step JOIN sp p
        ON p.category = step.category AND NOT list_contains(step.used, p.i) AND NOT list_contains(step.used, p.j) GROUP BY ALL)),
mates AS (SELECT category, i AS rank, j AS mate FROM step WHERE i IS NOT NULL UNION ALL SELECT category, j, i FROM step WHERE i IS NOT NULL)"""


@query(
    "gated_selection",
    f"""WITH RECURSIVE {GATED} SELECT pick.category, pick.rank, pick.word, o.word AS opposite FROM pick LEFT JOIN mates m ON m.category = pick.category AND m.rank = pick.rank
    LEFT JOIN pick o ON o.category = m.category AND o.rank = m.mate""",
)
def gated_selection(spark, sf):
    s = select_pools(pool_vectors(spark, sf), 12, THR, negatable=[0, 2, 4, 6, 8])
    return s.selected.select("category", "rank", "word", "opposite")


@query(
    "gated_selection_summary",
    f"""WITH RECURSIVE {GATED}, b AS (SELECT category, avg(least(sv, ss)) AS mean FROM q1 GROUP BY 1), c AS (SELECT category, count(*) AS n FROM p1 GROUP BY 1),
a AS (SELECT category, avg(sd) AS mean, arg_max(wi, sd) AS wa, arg_max(wj, sd) AS wb, max(sd) AS sim FROM sp GROUP BY 1), k AS (SELECT category, count(*) AS n FROM pick GROUP BY 1)
SELECT c.category, c.n AS candidates, len(kept) AS after_filter, k.n AS selected, c.n - len(kept) AS redundant_dropped, round(b.mean, 4) + 0.0 AS before_mean_sim,
    round(a.mean, 4) + 0.0 AS after_mean_sim, round(b.mean - a.mean, 4) + 0.0 AS improvement, wa AS similar_a, wb AS similar_b, round(sim, 4) + 0.0 AS similarity
FROM c JOIN kept USING (category) JOIN b USING (category) JOIN a USING (category) JOIN k USING (category)""",
)
def gated_selection_summary(spark, sf):
    s = select_pools(pool_vectors(spark, sf), 12, THR, negatable=[0, 2, 4, 6, 8]).summary.drop("elbow_k")
    return s.withColumns({c: F.col(c) + F.lit(0.0) for c in ("before_mean_sim", "after_mean_sim", "improvement", "similarity")})


# ---- probes ----------------------------------------------------------------------------------------


def _base(spark, sf):
    return pool_vectors(spark, sf).select("ordinal", "word", F.col("semantic").alias("vector"))


NEAREST = (
    f"""WITH {ALLPAIRS}, sym AS (SELECT i, j, ss AS s FROM pairs UNION ALL SELECT j, i, ss FROM pairs)
SELECT i AS id, round(max(s), 6) + 0.0 AS sim, arg_max(j, s) AS near_word FROM sym GROUP BY 1"""
)


@query("nearest_words", NEAREST)
def nearest_words(spark, sf):
    b = _base(spark, sf)
    n = nearest(b.select(F.col("ordinal").alias("id"), "vector"), b, exclude_self=True)
    return rounded(n.select("id", "sim", "near_word"), "sim")


@query("nearest_words_tiled", NEAREST)
def nearest_words_tiled(spark, sf):
    """The form for a base too large to ship."""
    b = _base(spark, sf)
    n = nearest(b.select(F.col("ordinal").alias("id"), "vector"), b, exclude_self=True, broadcast_bytes=0, rows=128)
    return rounded(n.select("id", "sim", "near_word"), "sim")


def _normal_sql(key: str) -> str:
    u = lambda k: f"('0x' || substr(md5({k}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    a = f"{key} || '/u'"
    b = f"{key} || '/v'"
    return f"sqrt(-2.0 * ln(1.0 - {u(a)})) * cos(2.0 * pi() * {u(b)})"


UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


@query(
    "void_points",
    f"""WITH {PV}, g AS (SELECT p.range AS id, d.range AS d, {_normal_sql("'42/probe/' || p.range::VARCHAR || '/' || d.range::VARCHAR")} AS x
    FROM range(0, (SELECT count(*) FROM embeddings)) p CROSS JOIN range(1, 33) d),
v0 AS (SELECT id, list(x ORDER BY d) AS v FROM g GROUP BY 1), probe AS (SELECT id, {UNIT} AS v FROM v0),
near AS (SELECT probe.id, max(list_dot_product(probe.v, pv.b)) AS sim, arg_max(pv.word, list_dot_product(probe.v, pv.b)) AS near_word FROM probe CROSS JOIN pv GROUP BY 1)
SELECT id, round(1 - sim, 6) + 0.0 AS distance, near_word FROM near ORDER BY 1 - sim DESC, id LIMIT 20""",
)
def void_points(spark, sf):
    """As many random probes as there are vectors."""
    b = _base(spark, sf)
    v = PB.find_voids(b, 32, 20, b.count())
    return rounded(v.select("id", "distance", "near_word"), "distance")


def _iterative_sql(rounds: int = 3, n_voids: int = 20) -> str:
    """Voids refined by jitter, round by round; each keeps the best of its own probes and of the rounds before."""
    n = "(SELECT count(*) FROM embeddings)"
    near = lambda r: f"""near{r} AS (SELECT probe{r}.id, any_value(v) AS v, 1 - max(list_dot_product(v, pv.b)) AS distance, arg_max(pv.word, list_dot_product(v, pv.b)) AS near_word FROM probe{r} CROSS JOIN pv GROUP BY 1),
top{r} AS (SELECT * FROM near{r} ORDER BY distance DESC, id LIMIT {n_voids})"""  # noqa: E731
    parts = [f"""g0 AS (SELECT p.range AS id, d.range AS p, {_normal_sql("'42/round0/' || p.range::VARCHAR || '/' || d.range::VARCHAR")} AS x FROM range(0, {n}) p CROSS JOIN range(1, 33) d),
l0 AS (SELECT id, list(x ORDER BY p) AS v FROM g0 GROUP BY 1), probe0 AS (SELECT id, {UNIT} AS v FROM l0), {near(0)}, best0 AS (SELECT * FROM top0)"""]
    for r in range(1, rounds):
        scale = repr(0.3 / (r + 1))
        key = f"'42/round{r}/' || id::VARCHAR || '/{scale}/' || copy::VARCHAR || '/' || p::VARCHAR"
        parts.append(f"""held{r} AS (SELECT greatest(1, {n} // count(*)) AS each FROM best{r - 1}),
placed{r} AS (SELECT row_number() OVER (ORDER BY distance DESC, id) AS id, v FROM best{r - 1}),
f{r} AS (SELECT id, copy, each, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM (SELECT id, v, each, unnest(range(0, each)) AS copy FROM placed{r} CROSS JOIN held{r})),
l{r} AS (SELECT (id - 1) * each + copy + {r} * greatest({n}, {n_voids}) AS id, list(x + {scale}::DOUBLE * {_normal_sql(key)} ORDER BY p) AS v FROM f{r} GROUP BY id, copy, each),
probe{r} AS (SELECT id, {UNIT} AS v FROM l{r}), {near(r)},
best{r} AS (SELECT * FROM (SELECT * FROM best{r - 1} UNION ALL SELECT * FROM top{r}) ORDER BY distance DESC, id LIMIT {n_voids})""")
    return f"WITH {PV}, {', '.join(parts)} SELECT id, round(distance, 6) + 0.0 AS distance, near_word FROM best{rounds - 1}"


@query("void_points_iterative", _iterative_sql())
def void_points_iterative(spark, sf):
    b = _base(spark, sf)
    v = PB.find_voids_iterative(b, 32, 20, b.count())
    return rounded(v.select("id", "distance", "near_word"), "distance")


@query(
    "interpolation",
    f"""WITH {PV}, nx AS (SELECT ordinal AS id, b AS a, lead(b) OVER (PARTITION BY category ORDER BY ordinal) AS b FROM pv),
f AS (SELECT id, t.range AS step, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS p FROM nx CROSS JOIN range(0, 7) t WHERE b IS NOT NULL),
m AS (SELECT id, step, p, (1 - step / 6.0::DOUBLE) * x + step / 6.0::DOUBLE * y AS v FROM f), n AS (SELECT id, step, sqrt(sum(v * v)) AS n FROM m GROUP BY ALL)
SELECT m.id, m.step::INTEGER AS step, round(m.step / 6.0::DOUBLE, 6) AS t, round(max(v / n) FILTER (p = 1), 6) + 0.0 AS first_entry, round(sum(v / n), 6) + 0.0 AS entry_sum
FROM m JOIN n ON m.id = n.id AND m.step = n.step GROUP BY ALL""",
)
def interpolation(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("ordinal")
    p = pool_vectors(spark, sf).select(F.col("ordinal").alias("id"), F.col("semantic").alias("a"), F.lead("semantic").over(w).alias("b"))
    v = PB.interpolation(p.filter("b is not null"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return v.select("id", "step", r6("t").alias("t"), r6(F.col("vector")[0]).alias("first_entry"), r6(total).alias("entry_sum"))


@query(
    "jitter_cloud",
    f"""WITH {PV}, f AS (SELECT pv.ordinal AS id, s.scale, c.range AS copy, unnest(b) AS x, generate_subscripts(b, 1) AS p FROM pv
    CROSS JOIN (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS scale) s CROSS JOIN range(0, 2) c),
m AS (SELECT id, scale, copy, p, x + scale * {_normal_sql("'42/jitter/' || id::VARCHAR || '/' || scale::VARCHAR || '/' || copy::VARCHAR || '/' || p::VARCHAR")} AS v FROM f),
n AS (SELECT id, scale, copy, sqrt(sum(v * v)) AS n FROM m GROUP BY ALL)
SELECT m.id, m.scale, m.copy::INTEGER AS copy, round(max(v / n) FILTER (p = 1), 6) + 0.0 AS first_entry, round(sum(v / n), 6) + 0.0 AS entry_sum
FROM m JOIN n ON m.id = n.id AND m.scale = n.scale AND m.copy = n.copy GROUP BY ALL""",
)
def jitter_cloud(spark, sf):
    j = PB.jitter(_base(spark, sf).select(F.col("ordinal").alias("id"), "vector"), n_per_scale=2)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return j.select("id", "scale", "copy", r6(F.col("vector")[0]).alias("first_entry"), r6(total).alias("entry_sum"))


# ---- archives --------------------------------------------------------------------------------------


def _entries(spark, sf):
    """The vectors as keyed archive entries, two per word, in load order."""
    v = pool_vectors(spark, sf)
    key = lambda s: F.concat_ws("/", F.col("category").cast("string"), F.concat(F.lit("w/"), F.col("word").cast("string")), F.lit(s))
    parts = F.explode(F.array(F.struct(key("clip").alias("key"), F.col("visual").alias("vector")), F.struct(key("t5").alias("key"), F.col("semantic").alias("vector"))))
    return v.select("ordinal", parts.alias("e")).select("e.key", "e.vector", "ordinal")


@query(
    "archive_scan",
    f"""WITH {PV} SELECT category::VARCHAR AS category, 'w/' || word::VARCHAR AS word, round(a[1], 6) + 0.0 AS visual_first, round(b[1], 6) + 0.0 AS semantic_first FROM pv""",
)
def archive_scan(spark, sf):
    a = SV.by_category(_entries(spark, sf))
    return a.select("category", "word", r6(F.col("visual")[0]).alias("visual_first"), r6(F.col("semantic")[0]).alias("semantic_first"))


@query("archive_one_space", f"WITH {PV} SELECT 'w/' || word::VARCHAR AS word, round(a[1], 6) + 0.0 AS first_entry FROM pv")
def archive_one_space(spark, sf):
    return SV.word_vectors(_entries(spark, sf)).select("word", r6(F.col("vector")[0]).alias("first_entry"))


@query(
    "archive_summary",
    'SELECT label::VARCHAR AS category, count(*) AS words, 32 AS visual_dim, 32 AS semantic_dim FROM embeddings GROUP BY 1',
)
def archive_summary(spark, sf):
    return SV.archive_summary(SV.by_category(_entries(spark, sf)))


@query(
    "missing_words",
    "SELECT DISTINCT (2 * label * 100 + vec_id)::VARCHAR AS word FROM embeddings WHERE 2 * label * 100 + vec_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_words(spark, sf):
    e = table(spark, sf, "embeddings")
    words = e.select((F.col("label") * 200 + F.col("vec_id")).cast("string").alias("word"))
    return SV.missing(words, e.select(F.col("vec_id").cast("string").alias("word")))


@query(
    "visual_relevance",
    """WITH n AS (SELECT vec_id AS ordinal, sqrt(list_dot_product(list_transform(embedding[1:32], lambda x: x::DOUBLE), list_transform(embedding[1:32], lambda x: x::DOUBLE))) AS n FROM embeddings)
SELECT ordinal, round(n / (SELECT max(n) FROM n), 6) + 0.0 AS score FROM n WHERE n / (SELECT max(n) FROM n) > 0.7""",
)
def visual_relevance(spark, sf):
    from wordloom.functions.vectors import norm
    from wordloom.operators.curation import visually_relevant

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), norm(F.slice("embedding", 1, 32)).alias("norm"))
    return rounded(visually_relevant(e, threshold=0.7).select("ordinal", "score"), "score")
