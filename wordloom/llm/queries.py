"""The operators over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression, convnet, decontaminate, forest, huffman, negatives, pii, repeats, rules, whitening, wildcard, zipwarc
from .samples import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    there = bpe.decode(coded.withColumn("pair", F.struct("doc_id", "n_tokens")), "pair")
    return there.select("pair.doc_id", "pair.n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans and those that the trained classifier adds."""
    docs = table(spark, sf_dir, "documents")
    rows = pii.find(docs.select("doc_id", "text"), pii.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed("spans", True), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, within the edit budget."""
    found = decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance")


@query(
    "op4_rule_ledger",
    r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, word FROM (
             SELECT k, generate_subscripts(x, 1) AS i, unnest(x) AS word FROM (SELECT k, string_split_regex(text, '[ 	-
]+') AS x FROM d)) WHERE word <> ''),
     g AS (SELECT k, i, word, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN
             word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' ||
             lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o END AS gram FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
     r AS (SELECT k, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY k, gram) > 1 AS twice FROM g),
     c AS (SELECT k, i, word, word = lag(word) OVER (PARTITION BY k ORDER BY i) AS same, bool_or(twice) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM r),
     m AS (SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars, sum(CASE WHEN inside THEN 1 ELSE 0 END) AS n_repeat_words,
             sum(length(regexp_replace(word, '[^\p{L}]', '', 'g'))) AS n_letters, sum(length(regexp_replace(word, '[^\p{Lu}]', '', 'g'))) AS n_capitals,
             sum(CASE WHEN word LIKE '%!!' THEN 1 ELSE 0 END) AS n_shouts,
             sum(CASE WHEN same THEN 1 ELSE 0 END) AS n_stutters FROM c GROUP BY k),
     l AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
             SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY k),
     a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters,
             coalesce(n_letters, 0) AS n_letters, coalesce(n_capitals, 0) AS n_capitals, coalesce(n_shouts, 0) AS n_shouts
           FROM d LEFT JOIN m USING (k) LEFT JOIN l USING (k)),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_capitals > 60 * n_letters OR
            100 * n_shouts > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_stutters > 30 * n_words) AS kept
FROM b""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and the verdict of the newest policy."""
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *measures, (~rules.passes("base")).alias("base_failed"), rules.passes("2").alias("kept"))


@query(
    "op5_near_duplicates",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w JOIN r ON r.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates, by shingles of two words."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"), k=2)


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read from them."""
    read = huffman.read_tokens(huffman.write_tokens(table(spark, sf_dir, "documents")))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SHA1_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + (((('0x' || substr(sha1({x}), 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '')"
)

@query(
    "op7_zip_warc",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     f AS (SELECT body, max(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(body) AS payload_bytes, {SHA1_BASE32.format(x="body")} AS payload_digest,
       CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < first THEN first END AS refers_to
FROM p JOIN f USING (body)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by ranges."""
    read = zipwarc.read_packages(zipwarc.write_packages(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= compression.CUT).cast("int").alias("predicted"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    rows = convnet.score(docs, convnet.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= convnet.CUT).cast("int").alias("predicted"))


@query(
    "op10_url_rules",
    r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^?#]*(\?[^#]*)?', 1) AS query FROM u),
     r AS (SELECT page_id, host, path, '.' || host || path || query AS whole, CASE
             WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN whole LIKE '%?page=%' OR whole LIKE '%?utm\_source=feed%' ESCAPE '\' OR whole LIKE '%/wp-login%' OR whole LIKE '%.exe' OR starts_with(path, '/ads/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    return wildcard.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op11_repeated_passages",
    r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
     g AS (SELECT k, i, array_to_string(w[i : i + 34], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
     t AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
     c AS (SELECT k, unnest(range(i, i + 35)) AS i FROM g SEMI JOIN t USING (gram)),
     r AS (SELECT DISTINCT k, i FROM c),
     x AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
     s AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN r USING (k, i) GROUP BY k)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (k)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that begin elsewhere too."""
    return repeats.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op12_hard_negatives",
    """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
           FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER o::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 5""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector, against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whitened, one row for each of the first 32 components."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    flat = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return flat.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
