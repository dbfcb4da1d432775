"""Bulk prompt generation without collisions.

Row r of a template stands for one draw of words: r is written in mixed radix (one digit per draw), and
each digit is shifted by a hash of the digits before it.  That map is a bijection, so no draw repeats,
needs only longs, and looks random.  A template is one branch of plain column arithmetic; with pools that
are measured to be small the words are literals of the plan and nothing is shuffled.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_uniform
from ..functions.text import cut_text, json_text
from ..session import cut
from ..sources.history import SMALL_BATCH, unseen
from ..sources.pools import BASE_NEGATIVES, NEGATABLE
from .ordered import dense_index
from .templates import template_parts

LITERAL_WORDS = 20_000  # pools up to this many words become literals of the plan
ARTIFACT_CHANCE = 0.002  # fixed value: one prompt in 500 is flagged


@dataclass
class Draw:
    category: str
    pool: int  # words to choose from
    skip: list[int] = field(default_factory=list)  # earlier draws whose words are taken


@dataclass
class Layout:
    """How one template is filled: literal pieces, slots with their draws, and all draws in order."""

    template_id: str
    pieces: list[str]
    slots: list[tuple[str, str, str, list[int]]]  # category, separator, slot text, draws
    draws: list[Draw]

    @property
    def capacity(self) -> int:
        total = 1
        for d in self.draws:
            total *= d.pool - len(d.skip)
        return total


def layouts(templates: DataFrame, components: DataFrame, reuse: bool = False) -> list[Layout]:
    """Fill plans of all templates.  Templates and category counts are configuration-sized.

    By default a category gives each word once per prompt, and slots past its end stay empty.  With
    ``reuse`` a slot that finds all words taken draws from the whole pool again.
    """
    sizes = {r["category"]: r["count"] for r in components.groupBy("category").count().collect()}
    out = []
    for t in template_parts(templates).orderBy("template_id").collect():
        tid = t["template_id"]
        draws: list[Draw] = []
        slots = []
        for r in t["slots"]:
            n = sizes.get(r["category"], 0)
            before = [i for i, d in enumerate(draws) if d.category == r["category"]]
            taken = list(before)
            if reuse and n - len(before) <= 0:
                taken = []
            mine: list[int] = []
            for _ in range(min(r["count"], max(n - len(taken), 0))):
                draws.append(Draw(r["category"], n, [*taken, *mine]))
                mine.append(len(draws) - 1)
            slots.append((r["category"], r["separator"], r["slot"], mine))
        out.append(Layout(tid, t["pieces"], slots, draws))
    return out


def _positions(df: DataFrame, lay: Layout, seed: int) -> DataFrame:
    """Add ``_i0``, ``_i1``, ...: the 0-based pool position of every draw of row ``rank``.

    One select whose later columns use the earlier ones; Spark stacks them into projections, so each
    digit is computed once.  floor(rand()) is always 0; it keeps filters on later columns from being pushed
    into that stack, where every use of a digit would write out all digits before it again.
    """
    given = df.columns
    cols = ["*", "rank AS _q0"]
    keys = ""
    for j, d in enumerate(lay.draws):
        radix = d.pool - len(d.skip)
        text = _quoted(f"{seed}/{lay.template_id}/{j}")
        shift = f"pmod(cast(conv(substring(md5(concat_ws('/', {text}{keys})), 1, 15), 16, 10) as bigint), {radix}L)"
        cols.append(f"pmod(pmod(_q{j}, {radix}L) + {shift}, {radix}L) AS _d{j}")
        cols.append(f"_q{j} div {radix}L AS _q{j + 1}")
        keys += f", cast(_d{j} as string)"
        if not d.skip:
            cols.append(f"_d{j} AS _i{j}")
        elif len(d.skip) == 1:
            cols.append(f"_d{j} + if(_d{j} >= _i{d.skip[0]}, 1L, 0L) AS _i{j}")
        else:
            taken = ", ".join(f"_i{i}" for i in d.skip)
            cols.append(f"aggregate(array_sort(array({taken})), _d{j}, (x, t) -> x + if(x >= t, 1L, 0L)) AS _i{j}")
    return df.selectExpr(*cols).selectExpr(*given, *[f"_i{j} + cast(floor(rand(0)) as bigint) AS _i{j}" for j in range(len(lay.draws))])


def _finish(df: DataFrame, lay: Layout, leave_missing: bool, extra: list[str]) -> DataFrame:
    """Prompt columns of one template from the words ``_w0``, ... of its draws, their JSON text ``_x0``, ...
    and their opposites ``_o0``, ...; columns ``extra`` stay."""
    text: list[str] = []
    for piece, slot in zip(lay.pieces, [*lay.slots, None]):
        if piece:
            text.append(_quoted(piece))
        if slot is None:
            continue
        category, sep, raw, mine = slot
        if mine:
            text.append(f"concat_ws({_quoted(sep)}, {', '.join(f'_w{j}' for j in mine)})")
        else:
            text.append(_quoted(raw if leave_missing else f"[missing {category}]"))
    by_cat: dict[str, list[int]] = {}
    for j, d in enumerate(lay.draws):
        by_cat.setdefault(d.category, []).append(j)

    def sorted_json(js: list[int]) -> str:
        if len(js) == 1:
            return f"_x{js[0]}"
        both = ", ".join(f"struct(_w{j} AS w, _x{j} AS x)" for j in js)
        return f"concat_ws(', ', transform(array_sort(array({both})), s -> s.x))"

    canon = [_quoted('{"c": {')]
    for n, c in enumerate(sorted(by_cat)):
        canon += [_quoted((", " if n else "") + json.dumps(c) + ": ["), sorted_json(by_cat[c]), "']'"]
    canon.append(_quoted('}, "t": ' + json.dumps(lay.template_id) + "}"))
    # concat_ws skips missing opposites; empty ones are dropped too
    against = [f"nullif(_o{j}, '')" for c in NEGATABLE for j in by_cat.get(c, [])]
    comp = ", ".join(f"{_quoted(c)}, array({', '.join(f'_w{j}' for j in js)})" for c, js in by_cat.items())
    return df.selectExpr(
        "prompt_no",
        "rank",
        f"{_quoted(lay.template_id)} AS template_id",
        f"concat({', '.join(text) or _quoted('')}) AS positive",
        f"concat_ws(', ', {', '.join([*against, *map(_quoted, BASE_NEGATIVES)])}) AS negative",
        (f"map({comp})" if comp else "from_json('{}', 'map<string,array<string>>')") + " AS components",
        f"substring(sha2(concat({', '.join(canon)}), 256), 1, 16) AS hash",
        *[f"`{c}`" for c in extra],
    )


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


COLUMNS = ["prompt_no", "rank", "template_id", "positive", "negative", "components", "hash"]


def generate(
    templates: DataFrame,
    components: DataFrame,
    n_per_template: int,
    seed: int = 42,
    start: int = 0,
    reuse: bool = False,
    leave_missing: bool = False,
    literal_words: int = LITERAL_WORDS,
    plan: list[Layout] | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """``n_per_template`` prompts of every template, from rank ``start`` on.

    Prompt numbers interleave the templates, so any prefix of them has the same share of each.  A
    template with fewer draws than asked for gives all it has.

    A prompt is a function of its number: with ``only``, a table of ``prompt_no`` and any other columns, the prompts of
    these numbers are made, with the other columns beside them.
    """
    spark = components.sparkSession
    comps = components.select("category", "ordinal", "word", *[c for c in ("opposite",) if c in components.columns])
    if "opposite" not in comps.columns:
        comps = comps.withColumn("opposite", F.lit(None).cast("string"))
    plan = layouts(templates, comps, reuse) if plan is None else plan
    if not plan:
        raise ValueError("no templates")
    used = {d.category for lay in plan for d in lay.draws}
    pool = comps.filter(F.col("category").isin(*used)) if used else comps.limit(0)
    total = sum({d.category: d.pool for lay in plan for d in lay.draws}.values())
    rows = []
    extra = [] if only is None else [c for c in only.columns if c != "prompt_no"]
    for t, lay in enumerate(plan):
        if only is not None:
            base = only.filter(F.col("prompt_no") % len(plan) == t).withColumn("rank", F.expr(f"prompt_no div {len(plan)}L"))
            rows.append(_positions(base, lay, seed))
            continue
        stop = min(start + n_per_template, lay.capacity)
        parts = min(spark.sparkContext.defaultParallelism, max(1, (stop - start) // 2_000)) if stop - start < 1 << 24 else max(
            spark.sparkContext.defaultParallelism, (stop - start) >> 22
        )
        ids = spark.range(start, max(stop, start), 1, parts).withColumnRenamed("id", "rank")
        base = ids.withColumn("prompt_no", F.col("rank") * len(plan) + t)
        rows.append(_positions(base, lay, seed))

    if total <= literal_words:
        held: dict[str, dict[str, Column]] = {}
        words: dict[str, list] = {}
        for r in pool.orderBy("category", "ordinal").collect():  # at most literal_words rows
            words.setdefault(r["category"], []).append(r)
        arr = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<string>")
        for c, rs in words.items():
            held[c] = {
                "word": arr([r["word"] for r in rs]),
                "json": arr([json.dumps(r["word"]) for r in rs]),
                "opposite": arr([r["opposite"] for r in rs]),
            }
        out = None
        for lay, df in zip(plan, rows):
            pick = [
                F.get(held[d.category][kind], F.col(f"_i{j}").cast("int")).alias(f"{name}{j}")
                for j, d in enumerate(lay.draws)
                for name, kind in (("_w", "word"), ("_x", "json"), ("_o", "opposite"))
            ]
            part = _finish(df.select("prompt_no", "rank", *extra, *pick), lay, leave_missing, extra)
            out = part if out is None else out.unionByName(part)
        return out.select(*COLUMNS, *extra)

    # large pools: positions become join keys, words come back to their prompt by one shuffle
    index = dense_index(pool, ["category"], "ordinal", "at").select(
        "category", (F.col("at") - 1).alias("at"), "word", json_text(F.col("word")).alias("json"), "opposite"
    )
    drawn = None
    for t, (lay, df) in enumerate(zip(plan, rows)):
        d = [F.struct(F.lit(j).alias("j"), F.lit(x.category).alias("category"), F.col(f"_i{j}").alias("at")) for j, x in enumerate(lay.draws)]
        empty = F.array().cast("array<struct<j:int,category:string,at:bigint>>")
        part = df.select("prompt_no", "rank", *extra, F.lit(t).alias("t"), (F.array(*d) if d else empty).alias("d"))
        drawn = part if drawn is None else drawn.unionByName(part)
    own = ["prompt_no", "rank", *extra, "t"]
    flat = drawn.select(*own, F.explode("d").alias("d")).select(*own, "d.*")
    full = flat.join(index, ["category", "at"]).groupBy(*own).agg(
        F.array_sort(F.collect_list(F.struct("j", "word", "json", "opposite"))).alias("w")  # one entry per draw
    )
    full = drawn.filter(F.size("d") == 0).select(*own, F.lit(None).cast(full.schema["w"].dataType).alias("w")).unionByName(full)
    full = full.persist()  # read once per template
    out = None
    for t, lay in enumerate(plan):
        pick = [
            f"element_at(w, {j + 1}).{kind} AS {name}{j}"
            for j in range(len(lay.draws))
            for name, kind in (("_w", "word"), ("_x", "json"), ("_o", "opposite"))
        ]
        part = _finish(full.filter(F.col("t") == t).selectExpr("prompt_no", "rank", *[f"`{c}`" for c in extra], *pick), lay, leave_missing, extra)
        out = part if out is None else out.unionByName(part)
    return out.select(*COLUMNS, *extra)


def generate_unique(
    templates: DataFrame,
    components: DataFrame,
    n: int,
    history: DataFrame | None = None,
    template_id: str | None = None,
    seed: int = 42,
    literal_words: int = LITERAL_WORDS,
    strict: bool = False,
    numbered: str | None = None,
) -> DataFrame:
    """``n`` prompts whose hashes are new to each other and to ``history``; with ``numbered``, a column of that name counts
    them 1, 2, 3, ... in the order of their numbers.

    Each round draws the next ranks, keeps the first prompt of each hash and drops known ones; the next round
    draws as many as the yield so far says the shortfall takes, and not more than all before it.  Only when the whole
    space is used up are there fewer than ``n``; ``strict`` raises ValueError then.  Rounds move hashes and prompt numbers
    only; the prompts of the chosen numbers are made at the end.
    """
    if template_id is not None:
        templates = templates.filter(F.col("id") == template_id)
    plan = layouts(templates, components)
    cap = max((lay.capacity for lay in plan), default=0)
    parts: list[DataFrame] = []
    have, start = 0, 0
    step = -(-n // max(len(plan), 1))
    while have < n and start < cap:
        fresh = generate(templates, components, step, seed, start, literal_words=literal_words, plan=plan)
        fresh = cut(fresh.groupBy("hash").agg(F.min("prompt_no").alias("prompt_no")))
        # The round's hashes, when they are counted to be few, go to the history, which is then only scanned.
        few = history is not None and fresh.count() <= SMALL_BATCH
        known = history.select("hash").join(F.broadcast(fresh.select("hash")), "hash", "left_semi") if few else history
        for old in [*([] if known is None else [known]), *parts]:
            fresh = unseen(fresh, old)
        parts.append(cut(fresh))
        have += parts[-1].count()
        start += step
        share = max(have / (start * len(plan)), 1 / (2 * start * len(plan)))
        step = min(max(math.ceil((n - have) / share / len(plan) * 1.1), 1), start, max(cap - start, 1))
    if strict and have < n:
        raise ValueError(f"{have} of {n} prompts: the space of these templates holds no more new ones")
    taken = components.sparkSession.createDataFrame([], "hash string, prompt_no bigint") if not parts else parts[0]
    for p in parts[1:]:
        taken = taken.unionByName(p)
    taken = taken.select("prompt_no")
    if have > n or numbered:  # the last step may give more than asked: the first n by prompt number stay
        place = numbered or "_place"
        taken = dense_index(taken, [], "prompt_no", place).filter(F.col(place) <= n)
        taken = cut(taken if numbered else taken.drop(place))  # read once per template
    made = generate(templates, components, 0, seed, literal_words=literal_words, plan=plan, only=taken)
    return made.select(*COLUMNS, *([numbered] if numbered else []))


def flag_artifacts(prompts: DataFrame, chance: float = ARTIFACT_CHANCE) -> DataFrame:
    """Flag each prompt with a small probability that depends on its hash only."""
    return prompts.withColumn("is_artifact", md5_uniform(F.col("hash")) < F.lit(chance))


def sample_words(components: DataFrame, keys: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k different words of every category for each key: positions by shifted digits, words by a join.

    ``keys`` has ``key`` (bigint).  Category sizes are configuration-sized; the words are not collected.
    """
    sizes = [(r["category"], r["count"]) for r in components.groupBy("category").count().collect()]
    index = dense_index(components.select("category", "ordinal", "word"), ["category"], "ordinal", "at")
    out = None
    for c, n in sizes:
        lay = Layout(f"sample/{c}", [], [], [Draw(c, n, list(range(i))) for i in range(min(k, n))])
        pos = _positions(keys.select(F.col("key").alias("rank")), lay, seed)
        cols = [F.struct(F.lit(j).alias("draw"), (F.col(f"_i{j}") + 1).alias("at")) for j in range(len(lay.draws))]
        part = pos.select(F.col("rank").alias("key"), F.lit(c).alias("category"), F.explode(F.array(*cols)).alias("d")).select("key", "category", "d.*")
        out = part if out is None else out.unionByName(part)
    return out.join(index, ["category", "at"]).select("key", "category", "draw", "word")


def first_samples(prompts: DataFrame, k: int, width: int = 100) -> DataFrame:
    """The first k prompts per template, cut for display."""
    from pyspark.sql import Window

    w = Window.partitionBy("template_id").orderBy("prompt_no")
    return (
        prompts.withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= k)
        .select("template_id", "place", cut_text(F.col("positive"), width).alias("sample"))
    )
