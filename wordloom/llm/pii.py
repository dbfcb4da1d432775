"""Personal data by weak supervision, in DataFrame functions only.

Base patterns and two looser ones give candidate spans.  Five labelers vote on each: the pattern with its checks, a
gazetteer, words of the context, the shape and the edges.  Votes are counted over all texts; expectation-maximisation
on the counts estimates how reliable each labeler is for each kind, without labels; its posteriors train the span
classifier.  Base spans always stand; the classifier adds others that lie apart from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import logistic

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: what they match is the same, a run of characters is read once, and nothing
#: recurses.  A match may begin inside a run of an address's characters only where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![+0-9A-Za-z.-])(?<![0-9] )\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}+(?![ .-]?[0-9A-Za-z])",
}
LABELERS = ("pattern", "gazetteer", "context", "shape", "edges")
#: Length buckets of the classifier; characters of context; score from which a span is added; rounds of estimation.
BUCKETS, CONTEXT, ADD, ROUNDS = 8, 24, 0.9, 40

#: Top-level domains, calling codes, words that speak for or against a kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "co", "us")
CALLING = ("1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "61", "81", "86", "91")
FOR = {
    "email": "e-?mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": "card|visa|master|amex|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|ruf|appel|llam",
}
AGAINST = r"version|isbn|issn|order|invoice|build|page|chapter|\bno\.|№|#|§"


#: Matches whose places are added up one after the other; more are added up by blocks of so many.
RUN = 256


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """The sums up to each entry of an array of one entry or more, in time linear in its size."""

    def block(a: Column, b: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(F.slice(a, b * RUN + 1, F.lit(RUN)), begin, step, lambda acc: acc["out"])

    def joined(h: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + F.element_at(x, -1)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        heads = F.aggregate(h["blocks"], begin, step, lambda acc: acc["out"])
        return _once(F.struct(heads.alias("heads"), h["blocks"].alias("blocks")), lambda g: F.flatten(F.transform(g["blocks"], lambda x, i: F.transform(x, lambda y: y + F.get(g["heads"], i)))))

    last = lambda a: F.floor((F.size(a) - 1) / RUN).cast("int")
    blocks = _once(F.struct(lengths.alias("a")), lambda h: F.transform(F.sequence(F.lit(0), last(h["a"])), lambda b: block(h["a"], b)))
    return _once(F.struct(blocks.alias("blocks")), joined)


def _of(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Spans of one pattern: kind, start, end (code points), value, what stands before, the character after.  The
    texts between the matches give the places; a text without a match is looked at once."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string,loose:boolean>>")

    def listed(h: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            gap, end = F.get(h["gaps"], i), F.get(h["ends"], i)
            return F.struct(
                F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"),
                F.substring(gap, F.greatest(F.length(gap) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("before"),
                F.substring(F.get(h["gaps"], i + 1), 1, 1).alias("after"), F.lit(not base).alias("loose"),
            )

        return F.transform(h["values"], span)

    def placed(h: Column) -> Column:
        lengths = F.transform(h["values"], lambda v, i: F.length(F.get(h["gaps"], i)) + F.length(v))
        return _once(F.struct(h["values"].alias("values"), h["gaps"].alias("gaps"), _running(lengths).alias("ends")), listed)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _once(found, placed)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(s: Column) -> Column:
    """Do the base checks hold of a match of its base pattern?"""
    n = F.length(_digits(s["value"]))
    small = F.forall(F.split(s["value"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(
        F.split(s["value"], r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+(?=[0-9])", "")), -3, 3) <= "255"
    )
    return ~s["loose"] & (
        F.when(s["kind"] == "ip", small)
        .when(s["kind"] == "card", n.between(16, 19) & F.call_function("luhn_check", _digits(s["value"])))
        .when(s["kind"] == "phone", n.between(8, 15))
        .otherwise(F.lit(True))
    )


def _votes(s: Column) -> dict[str, Column]:
    """1 for, 0 against, -1 no opinion, by labeler."""
    kind, value, digits = s["kind"], s["value"], _digits(s["value"])
    yes = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    before = F.lower(s["before"])
    context = F.lit(-1)
    for k in KINDS:
        context = F.when((kind == k) & before.rlike(FOR[k]), F.lit(1)).otherwise(context)
    return {
        "pattern": yes(s["valid"]),
        "gazetteer": F.when(kind == "email", yes(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS)))
        .when(kind == "phone", F.when(value.startswith("+"), yes(F.substring(digits, 1, 1).isin("1") | F.substring(digits, 1, 2).isin(*CALLING))).otherwise(F.lit(-1)))
        .when(kind == "card", yes(F.substring(digits, 1, 1).isin("3", "4", "5", "6")))
        .otherwise(yes(~F.regexp_extract(value, "^[0-9]+", 0).isin("0", "127", "255"))),
        "context": F.when(before.rlike(AGAINST), F.lit(0)).otherwise(context),
        "shape": F.when(kind == "email", yes(value.rlike("^[A-Za-z0-9].*[A-Za-z].*[@)\\]]")))
        .when(kind == "phone", yes(value.rlike(r"[ ().-]") & F.length(digits).between(9, 13)))
        .when(kind == "card", yes(value.rlike("^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$")))
        .otherwise(yes(~value.rlike(r"(^|\.)0[0-9]"))),
        "edges": yes(~F.substring(s["before"], -1, 1).rlike(r"[\p{L}\p{N}_]") & ~s["after"].rlike(r"[\p{L}\p{N}_]")),
    }


def candidates(text: Column) -> Column:
    """All candidate spans of a text with ``valid``, the votes and a length bucket."""
    found = F.concat(*[_of(text, k, BASE[k], True) for k in KINDS], *[_of(text, k, p, False) for k, p in LOOSE.items()])
    # Matches that fail the checks stay as cases that speak against a kind; they are never added.
    found = F.transform(found, lambda s: s.withField("valid", _valid(s)))

    def voted(s: Column) -> Column:
        v = _votes(s)
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["valid"].alias("valid"), s["loose"].alias("loose"),
            *[v[name].alias(name) for name in LABELERS], F.least(F.floor((s["end"] - s["start"]) / 4), F.lit(BUCKETS - 1)).cast("int").alias("bucket"),
        )

    return F.transform(found, voted)


@dataclass(frozen=True)
class Model:
    """The classifier's weights by (kind, labeler, vote), then by (kind, bucket); and each labeler's estimated rates."""

    weights: tuple[float, ...]
    rates: dict


def _estimate(rows: list[tuple[tuple[int, ...], float]]) -> tuple[list[float], dict]:
    """Posteriors of the vote patterns of one kind, and P(vote | truth) of each labeler."""
    post = []
    for votes, _ in rows:
        said = [v for v in votes if v >= 0]
        post.append(0.05 + 0.9 * (sum(said) / len(said) if said else 0.5))
    rates: dict = {}
    for _ in range(ROUNDS):
        mass = [sum(n * p for (_, n), p in zip(rows, post, strict=True)), sum(n * (1 - p) for (_, n), p in zip(rows, post, strict=True))]
        prior = (mass[0] + 1) / (mass[0] + mass[1] + 2)
        for k, name in enumerate(LABELERS):
            for v in (-1, 0, 1):
                on = sum(n * p for (votes, n), p in zip(rows, post, strict=True) if votes[k] == v)
                off = sum(n * (1 - p) for (votes, n), p in zip(rows, post, strict=True) if votes[k] == v)
                # A labeler starts out better than a coin: that keeps the two classes from changing places.
                up, down = {-1: (1, 1), 0: (1, 4), 1: (4, 1)}[v]
                rates[name, v] = ((on + up) / (mass[0] + 6), (off + down) / (mass[1] + 6))
        post = []
        for votes, _ in rows:
            a = math.log(prior) - math.log(1 - prior) + sum(math.log(rates[name, v][0] / rates[name, v][1]) for name, v in zip(LABELERS, votes, strict=True))
            post.append(1 / (1 + math.exp(-max(-30, min(30, a)))))
    return post, rates


def train(df: DataFrame, text_col: str = "text") -> Model:
    """Votes of all candidates of all texts, counted by pattern, then estimation and the classifier on the counts.

    The driver gets at most 4 kinds * 3**5 patterns * ``BUCKETS`` counts, whatever the size of the table.
    """
    spans = df.select(F.explode(candidates(F.coalesce(df[text_col].cast("string"), F.lit("")))).alias("s"))
    counts = spans.groupBy(*[F.col(f"s.{c}").alias(c) for c in ("kind", *LABELERS, "bucket")]).agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: tuple(r)[:-1])
    x, y, w, rates = [], [], [], {}
    for kind in KINDS:
        mine = [r for r in counts if r["kind"] == kind]
        post, rates[kind] = _estimate([(tuple(r[name] for name in LABELERS), r["n"]) for r in mine])
        for r, p in zip(mine, post, strict=True):
            row = [0.0] * _width()
            for at in _places(KINDS.index(kind), [r[name] for name in LABELERS], r["bucket"]):
                row[at] = 1.0
            x += [row, row]
            y += [1.0, 0.0]
            w += [r["n"] * p, r["n"] * (1 - p)]
    if not x:
        return Model((0.0,) * _width() + (-30.0,), rates)
    return Model(tuple(logistic(np.array(x), np.array(y), np.array(w), 0.1).tolist()), rates)


def _width() -> int:
    return len(KINDS) * (len(LABELERS) * 3 + BUCKETS)


def _places(kind, votes, bucket) -> list:
    """The inputs that are 1, by number: works on numbers and on columns."""
    n = len(LABELERS) * 3 + BUCKETS
    return [kind * n + k * 3 + v + 1 for k, v in enumerate(votes)] + [kind * n + len(LABELERS) * 3 + bucket]


def spans(text: Column, model: Model) -> Column:
    """array<struct<kind, start, end, base>>: base spans, and added ones that touch none of them; by kind, then start."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights[:-1]])
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]) - 1

    def chance(s: Column) -> Column:
        total = F.lit(float(model.weights[-1]))
        for at in _places(rank(s), [s[name] for name in LABELERS], s["bucket"]):
            total = total + F.element_at(weights, (at + 1).cast("int"))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def pick(all_: Column) -> Column:
        base = F.filter(all_, lambda s: s["valid"])
        more = F.filter(all_, lambda s: s["loose"] & (chance(s) >= ADD) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        slim = lambda a, flag: F.transform(a, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("base"), s["kind"].alias("kind")))
        return F.array_sort(F.concat(slim(base, True), F.array_distinct(slim(more, False))))

    return pick(candidates(text))


def find(df: DataFrame, model: Model, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with the spans of each row's whole text in ``into``; a column of that name is replaced.

    A null or empty text has no spans; very long texts are read whole; repeated rows get equal spans; an empty table
    stays empty.  One pass, no shuffle, nothing but built-in functions.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.withColumn(into, F.when(text.rlike("[0-9@\\[(]"), spans(text, model)).otherwise(F.array().cast(f"array<struct<{SPAN}>>")))


SPAN = "rank:bigint,start:int,end:int,base:boolean,kind:string"


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with every span of the text put as its kind, like ``[EMAIL]``; spans of two kinds that overlap become
    one.  Null texts stay null."""
    name = "__spans"
    while name in df.columns:
        name = f"_{name}"
    held = find(df, model, text_col, name)
    # Spans far from one another in a very long text: each piece between them is read once.
    order = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.when(apart, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(order, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return held.withColumn(text_col, F.when(F.size(name) > 0, masked).otherwise(text)).drop(name)


def listed(spans_col: str | Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    s = F.col(spans_col) if isinstance(spans_col, str) else spans_col
    s = F.filter(s, lambda x: x["base"]) if base_only else s
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
