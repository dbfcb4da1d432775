"""Batch generation into a history table, and the statistics of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.generation import generate_unique
from ..operators.templates import parse_slots, total_combinations
from ..sources.history import existing, export_text, read_history


def run_batch(templates: DataFrame, components: DataFrame, n: int, path: str, history: DataFrame | None = None,
              template_id: str | None = None, seed: int = 42) -> DataFrame:
    """Generate n new prompts, append them to the table at ``path`` and return the rows as they are stored there.

    What the table holds already counts as history, with ``history`` or without; ids continue after the
    greatest id of both.
    """
    stored = existing(components.sparkSession, path)
    known = [h.select("hash", "id") for h in (history, stored) if h is not None]
    seen = None if not known else known[0] if len(known) == 1 else known[0].unionByName(known[1])
    new = generate_unique(templates, components, n, seen, template_id, seed, numbered="_place")
    last = 0 if seen is None else int(seen.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    rows = new.select(
        (F.col("_place") + last).alias("id"), "hash", "template_id", "positive", "negative", "components",
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("favorited"),
    )
    # new to each other and to the table, so nothing is left to compare: written once, and read from there
    rows.write.mode("append").parquet(path)
    stored = components.sparkSession.read.schema(rows.schema).parquet(path)
    return stored.filter(F.col("id").between(last + 1, last + max(n, 0)))


def statistics(path: str, templates: DataFrame, components: DataFrame) -> dict[str, DataFrame]:
    h = read_history(components.sparkSession, path)
    total = total_combinations(parse_slots(templates), components).first()["permutations"]
    return {"summary": H.summary(h), "by_template": H.by_template(h), "coverage": H.coverage(h, int(total))}


def emit(prompts: DataFrame, path: str, fmt: str = "text") -> None:
    """Positive texts, or whole prompts as JSON Lines."""
    if fmt == "text":
        export_text(prompts, path)
    else:
        prompts.write.mode("overwrite").json(path)
