"""Text columns: term lines, vocabulary tokens, spans, JSON text of words."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Line clean-up rules.
LEADING_MARKS = r"^[\d.\-*•]+\s*"
QUOTES = "\"'`"
# The white space a Python str.strip() removes, as far as text files hold it.
BLANKS = (
    " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085        "
    "         　"
)
WORD_START = "▁"  # marks a token that starts a word


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def clean_term(line: Column) -> Column:
    """One raw line -> lower-case term, or NULL when it is no usable term."""
    bare = strip(strip(F.regexp_replace(strip(line), LEADING_MARKS, ""), QUOTES))
    n_words = F.size(F.split(bare, "[" + BLANKS + "]+"))
    ok = (F.length(bare) > 1) & (F.length(bare) < 60) & (n_words <= 5)
    return F.when(ok, F.lower(bare))


def term_lines(text: Column) -> Column:
    """All usable terms of a text, one per line, in line order."""
    return F.filter(F.transform(F.split(strip(text), "\n"), clean_term), lambda t: t.isNotNull())


def vocabulary_token(token: Column) -> Column:
    """Clean token text, or NULL for markers, short fragments and non-ASCII tokens."""
    clean = strip(F.regexp_replace(token, WORD_START, " "))
    keep = (
        ~token.startswith("<")
        & (token.startswith(WORD_START) | (F.length(token) >= 3))
        & (F.length(clean) >= 2)
        & clean.rlike(r"^[\x00-\x7F]+$")
        & ~clean.startswith("<")
    )
    return F.when(keep, clean)


def occurrences(text: Column, word: Column) -> Column:
    """Start offsets (0-based) of all non-overlapping occurrences of ``word`` in ``text``."""
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, quoted, -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    step = F.length(word)
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        lengths,
        seed,
        lambda s, n: F.struct(
            (s["at"] + n + step).cast("int").alias("at"),
            F.concat(s["starts"], F.array((s["at"] + n).cast("int"))).alias("starts"),
        ),
        lambda s: s["starts"],
    )
    return F.when((step > 0) & (F.size(pieces) > 1), walked).otherwise(F.array().cast("array<int>"))


def json_text(words: Column) -> Column:
    """JSON string of each word with ASCII escapes; used once per pool word, never per prompt."""

    @F.pandas_udf("string")
    def dump(s: pd.Series) -> pd.Series:
        return s.map(lambda w: json.dumps(w), na_action="ignore")

    return dump(words)


def cut_text(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
