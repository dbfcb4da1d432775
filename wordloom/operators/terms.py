"""Term harvesting and the accounting of the requests that produced the terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_long
from ..functions.text import term_lines
from ..session import cut, spread
from .ordered import CHUNK_ROWS, running_sum

SENT_ROWS = 1 << 17  # rows of numbers beside a short key: a few MB


def parse_terms(texts: DataFrame, keep: list[str] = ["category"]) -> DataFrame:
    """Clean terms of raw texts, one row per usable line."""
    return spread(texts).select(*keep, F.posexplode(term_lines(F.col("text"))).alias("line", "term"))


def new_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (category, term) pairs that are not known yet."""
    return terms.select("category", "term").distinct().join(known.select("category", "term"), ["category", "term"], "left_anti")


def added_counts(terms: DataFrame, known: DataFrame) -> DataFrame:
    """How many terms each category gains."""
    return new_terms(terms, known).groupBy("category").agg(F.count(F.lit(1)).alias("added"))


def fill_levels(terms: DataFrame, target: int = 300) -> DataFrame:
    """Distinct terms per category against the target."""
    n = terms.groupBy("category").agg(F.count_distinct("term").alias("count"))
    return n.select("category", "count", (F.col("count") < target).alias("incomplete"))


def avoid_list(terms: DataFrame, size: int = 60, seed: int = 42) -> DataFrame:
    """Per category a hash-ordered sample of at most ``size`` terms as text, and how many are left out.

    The rank filter is applied before the shuffle, so a large category sends ``size`` rows per task.
    """
    each = terms.select("category", "term").distinct()
    w = Window.partitionBy("category").orderBy("_h", "term")
    ranked = each.withColumn("_h", md5_long(F.concat_ws("/", F.lit(str(seed)), "category", "term"))).withColumn("_r", F.row_number().over(w))
    picked = ranked.filter(F.col("_r") <= size).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("p"))
    total = each.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(", ", F.transform("p", lambda x: x["term"]))
    more = F.when(F.col("n") > size, F.concat(F.lit(" ... and "), (F.col("n") - size).cast("string"), F.lit(" others"))).otherwise("")
    return picked.join(total, "category").select("category", F.concat(text, more).alias("avoid"), F.size("p").alias("listed"), F.col("n").alias("total"))


# ---- usage ----------------------------------------------------------------------------------------

# Price schemes: how the token counts of a model are billed (prices are per million tokens).
SPLIT_CACHE = "split_cache"  # input, cache_write, cache_read and output are counted apart
CACHED_DISCOUNT = "cached_discount"  # input includes the cached tokens, which are cheaper
FLAT = "flat"  # input and output only
MILLION = 1_000_000.0


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost``: the reported cost where there is one, else the price formula of the model.

    ``usage`` has ``model``, ``input``, ``output``, ``cached``, ``cache_write``, ``cache_read`` and
    ``reported_cost``; ``prices`` has ``model``, ``scheme`` and a price per kind of token.
    """
    p = prices.select("model", "scheme", *[F.coalesce(c, F.lit(0.0)).alias(f"_p_{c}") for c in ("input", "output", "cache_write", "cache_read", "cached_input")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    bill = lambda tokens, kind: tokens * F.col(f"_p_{kind}") / MILLION
    out = bill(z("output"), "output")
    split = bill(z("input"), "input") + bill(z("cache_write"), "cache_write") + bill(z("cache_read"), "cache_read") + out
    discount = bill(F.greatest(z("input") - z("cached"), F.lit(0.0)), "input") + bill(z("cached"), "cached_input") + out
    flat = bill(z("input"), "input") + out
    formula = F.when(F.col("scheme") == SPLIT_CACHE, split).when(F.col("scheme") == CACHED_DISCOUNT, discount).otherwise(flat)
    return usage.join(_beside(p), "model", "left").select(*usage.columns, F.coalesce("reported_cost", formula).alias("cost"))


def _beside(few: DataFrame) -> DataFrame:
    """``few``, sent to all tasks where it is counted to be small: a join of many rows with few keys would put all rows
    of a key into one task."""
    return F.broadcast(few) if few.count() <= SENT_ROWS else few


def usage_totals(costed: DataFrame) -> DataFrame:
    """Requests, tokens and cost per model with the cache-hit percentage, and a totals row (model NULL)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    # per model first: the rollup then doubles a row per model, not every request
    per = costed.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(z("input") + z("cache_read") + z("cache_write")).alias("input_tokens"),
        F.sum(z("output")).alias("output_tokens"),
        F.sum(z("cache_read") + z("cached")).alias("cached_tokens"),
        F.sum("cost").alias("cost"),
    )
    kinds = ("requests", "input_tokens", "output_tokens", "cached_tokens", "cost")
    sums = per.rollup("model").agg(*[F.sum(c).alias(c) for c in kinds])
    return sums.withColumn("cache_hit_pct", F.col("cached_tokens") / F.greatest(F.col("input_tokens"), F.lit(1)) * 100)


def within_caps(costed: DataFrame, caps: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Requests admitted under each model's cost cap.

    The cap is tested once per iteration, against the cost of all earlier iterations, so an iteration is
    admitted as a whole.  Costs are summed per (model, iteration) before any window runs.
    """
    per = costed.groupBy("model", "iteration").agg(F.sum("cost").alias("_c"))
    run = running_sum(per, ["model"], "iteration", {"spent_before": "_c"}, inclusive=False, chunk_rows=chunk_rows)
    admitted = run.join(caps.select("model", "cap"), "model", "left").filter(
        F.col("cap").isNull() | (F.col("spent_before") < F.col("cap"))
    )
    return costed.join(_beside(cut(admitted.select("model", "iteration", "spent_before"))), ["model", "iteration"])
