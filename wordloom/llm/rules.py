"""Quality rules as a ledger of bits.

Each text is measured once; each rule that it fails sets a bit.  What is kept is a matter of policies, versioned masks
over those bits, so another policy or an ablation reads the ledger and never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, two

SPACE = " \\t-\\r"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_shouts", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """A text fails where ``fails`` holds of its measures."""

    name: str
    fails: str


#: A rule's place is its bit; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_capitals > 60 * n_letters"),
    Rule("shouts", "100 * n_shouts > 20 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("stutters", "100 * n_stutters > 30 * n_words"),
)
BASE = ("few_words", "repeats")
#: Versions of policies: the rules whose failure rejects.
POLICIES = {
    "base": BASE,
    "1": (*BASE, "symbols", "capitals", "dup_lines"),
    "2": (*BASE, "symbols", "capitals", "shouts", "word_length", "stutters"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def measure_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a batch; words and lines become numbers first, equal ones equal numbers."""
    n = len(texts)
    parts = pc.split_pattern_regex(texts, f"[{SPACE}]+")
    doc = np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(parts.flatten())
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = coded.dictionary
    sizes = pc.utf8_length(kinds).to_numpy(zero_copy_only=False).astype(np.int64)
    real = sizes[word] > 0 if len(word) else np.zeros(0, bool)
    doc, word = doc[real], word[real]
    per = lambda of: np.bincount(doc, of[word], n).astype(np.int64) if len(word) else np.zeros(n, np.int64)
    count = lambda pattern: pc.count_substring_regex(kinds, pattern).to_numpy(zero_copy_only=False)
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": per(sizes),
        "n_symbols": per(count("[#*$%&|<>]")),
        "n_letters": per(count(r"\p{L}")),
        "n_capitals": per(count(r"\p{Lu}")),
        "n_shouts": per(count("!!$")),
    }
    again = doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])]
    out["n_stutters"] = np.bincount(again, minlength=n).astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(lines.flatten())
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.match_substring_regex(coded.dictionary, f"[^{SPACE}]").to_numpy(zero_copy_only=False)
    keep = full[line] if len(line) else np.zeros(0, bool)
    line_doc, line = line_doc[keep], line[keep]
    out["n_lines"] = np.bincount(line_doc, minlength=n).astype(np.int64)
    different = np.unique(line_doc * (len(full) + 1) + line) // (len(full) + 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(different, minlength=n)
    out["n_repeat_words"] = _repeated(doc, word, n)
    return out


def _repeated(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of ``WINDOW`` words that their text has twice or more.  A window's number comes from those of
    its halves, so equal numbers are equal words, without hashing."""
    if len(word) < WINDOW:
        return np.zeros(n, np.int64)
    rank, size = word, 1
    while size < WINDOW:
        a, b = rank[: len(rank) - size], rank[size:]
        rank = pd.factorize(a * (int(rank.max()) + 1) + b)[0].astype(np.int64)
        size *= 2
    inside = np.flatnonzero(doc[: len(rank)] == doc[WINDOW - 1 :])
    own = pd.factorize(doc[inside] * (int(rank.max()) + 1) + rank[inside])[0]
    starts = inside[np.bincount(own)[own] > 1] if len(own) else inside
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, the measures, and ``failed``: the bits of the rules that the text fails.

    One pass, no shuffle.  A null text is an empty one: no words, so it fails ``few_words``.  Long texts are measured
    whole; repeated rows and null ids are rows like any other; other columns are not carried.
    """
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            m = measure_batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k], pa.int64()) for k in MEASURES)], ["id", *MEASURES])

    out = two(df, id_col, text_col).mapInArrow(run, f"id {key.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.withColumn("failed", failed).withColumnRenamed("id", id_col)


def passes(policy: str = "2", failed: Column | None = None, policies: dict = POLICIES, rules: tuple[Rule, ...] = RULES) -> Column:
    """Does a row of the ledger pass the policy?"""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policies[policy], rules)).cast("long")) == 0


def ablation(rows: DataFrame, policies: dict = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, rule, n_failed, n_only (failed by this rule alone), n_kept, n_kept_without: from the ledger's bits.

    The ledger is counted by its bits first, at most ``2 ** len(rules)`` rows; an empty ledger gives no rows.
    """
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(names, rules)).cast("long").alias("all"), F.lit(mask((name,), rules)).cast("long").alias("bit"))
        for v, names in policies.items() for name in names
    ])
    hit = counts.select("n", "failed", F.explode(cases).alias("c")).select("n", "failed", "c.*").withColumn("seen", F.col("failed").bitwiseAND(F.col("all")))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return hit.groupBy("policy", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("seen") == F.col("bit")).alias("n_only"),
        total(F.col("seen") == 0).alias("n_kept"),
        total(F.col("seen").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
