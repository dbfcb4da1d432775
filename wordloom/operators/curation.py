"""Rule-driven pool edits: remove, move, cull, restore.  Rules are tables, so they scale with the pool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    """Rule tables of one curation.

    ``garbage``, ``removed``: (word).  ``moves``: (word, from_category, to_category), one per word.
    ``duplicates``: (keep, drop).  ``restores``: (category, word, place), in order of restoring.
    """

    garbage: DataFrame
    removed: DataFrame
    moves: DataFrame
    duplicates: DataFrame
    restores: DataFrame


def deny(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose word is on no deny list; Spark broadcasts the list when it measures it to be small."""
    return df.join(listed.select("word").distinct(), "word", "left_anti")


def _steps(pool: DataFrame, rules: Rules, original: DataFrame | None, require_keep: bool, as_review: bool):
    """The pool after every step, and the matches of every step.

    ``as_review`` lets every step see the unedited pool.
    """
    start = pool.select("category", "ordinal", "word")
    log: list[DataFrame] = []

    def note(step: str, rows: DataFrame, target=None) -> None:
        log.append(rows.select(F.lit(step).alias("step"), "word", F.col("category").alias("from_category"),
                               (F.lit(None).cast("string") if target is None else target).alias("to_category")))

    after = int(start.agg(F.max("ordinal")).first()[0] or 0) + 1  # moved words come after all that stay
    now = start
    for step, listed in (("garbage", rules.garbage), ("remove", rules.removed)):
        names = listed.select("word").distinct()
        note(step, (start if as_review else now).join(names, "word", "left_semi"))
        now = now.join(names, "word", "left_anti")

    # a word has one move rule, and only the category named in it is left
    moves = rules.moves.select("word", F.col("from_category").alias("category"), "to_category")
    seen = start if as_review else now
    note("move", seen.join(moves, ["word", "category"]), F.col("to_category"))
    moved = now.join(moves, ["word", "category"])
    stay = now.join(moves, ["word", "category"], "left_anti")
    arrive = moved.select("word", F.col("to_category").alias("category"), (F.col("ordinal") + F.lit(after)).alias("ordinal"))
    now = stay.select("category", "ordinal", "word").unionByName(
        arrive.join(stay.select("word", "category"), ["word", "category"], "left_anti")
    )

    drops = rules.duplicates
    if require_keep:
        drops = drops.join(now.select(F.col("word").alias("keep")).distinct(), "keep", "left_semi")
    names = drops.select(F.col("drop").alias("word")).distinct()
    note("duplicate", (start if as_review else now).join(names, "word", "left_semi"))
    now = now.join(names, "word", "left_anti")

    if original is not None:
        seen = start if as_review else now
        held = seen.select("word").distinct()
        live = start.select("category").distinct() if as_review else start.select("category").union(arrive.select("category")).distinct()
        back = (
            rules.restores.join(original.select("category", "word").distinct(), ["category", "word"], "left_semi")
            .join(live, "category", "left_semi")
            .join(held, "word", "left_anti")
        )
        if not as_review:  # a word restored to an earlier category is present for the later ones
            back = back.groupBy("word").agg(F.min_by(F.struct("category", "place"), "place").alias("r")).select(
                "word", "r.category", "r.place"
            )
        note("restore", back)
        now = now.unionByName(back.select("category", (F.col("place") + F.lit(2 * after)).alias("ordinal"), "word"))
    return now, log


def curate(pool: DataFrame, rules: Rules, original: DataFrame | None = None, require_keep: bool = False) -> DataFrame:
    """The pool after all five steps; moved and restored words come last in their category."""
    return _steps(pool, rules, original, require_keep, False)[0]


def curation_log(pool: DataFrame, rules: Rules, original: DataFrame | None = None, as_review: bool = False) -> DataFrame:
    """Every action: (step, word, from_category, to_category).  ``as_review`` applies no step before the next."""
    log = _steps(pool, rules, original, False, as_review)[1]
    out = log[0]
    for part in log[1:]:
        out = out.unionByName(part)
    return out


def void_words(probe: DataFrame, *deny_lists: DataFrame) -> DataFrame:
    """Nearest words of void points, without empty and denied ones.  ``probe`` has ``voids`` (array of structs)."""
    found = probe.select(F.posexplode("voids").alias("place", "v")).select("place", F.col("v.nearest").alias("word"))
    found = found.filter(F.coalesce(F.col("word"), F.lit("")) != "")
    for listed in deny_lists:
        found = deny(found, listed)
    return found


def visually_relevant(df: DataFrame, norm: str = "norm", threshold: float = 0.15) -> DataFrame:
    """Rows whose raw vector norm is more than ``threshold`` of the greatest; adds ``score``.

    The greatest norm is one scalar, so no window pulls the table into a task.
    """
    top = df.agg(F.max(norm)).first()[0]
    return df.withColumn("score", F.col(norm) / F.lit(float(top) if top else 1.0)).filter(F.col("score") > threshold)
