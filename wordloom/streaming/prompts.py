"""Prompt streams: de-duplication, carried state, running counts, idempotent append, metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.presets import INITIAL_STATE
from ..operators.state import apply_to_state, dynamics
from ..sources.history import append_new

STATE = "slots map<string,array<string>>, template string"


def distinct_prompts(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First prompt of each hash.  With an event time, hashes older than ``delay`` are forgotten,
    so the state stays bounded; without one every hash is kept."""
    if event_time is None:
        return stream.dropDuplicates(["hash"])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["hash"])


def running_counts(stream: DataFrame) -> DataFrame:
    """Prompts and first and last time per template, for update or complete mode."""
    return stream.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_generated"), F.max("created_at").alias("last_generated")
    )


def carried_state(stream: DataFrame, key: str, defaults: dict[str, list[str]] = INITIAL_STATE) -> DataFrame:
    """The state after every prompt, per key, kept between micro-batches.

    ``stream`` has the key, ``id``, ``template_id`` and ``components``.  Inside a micro-batch prompts are
    applied in ``id`` order.  A key's rows of one micro-batch arrive in Arrow chunks, sorted chunk by chunk,
    so the source should bound a micro-batch (``maxFilesPerTrigger``).
    """
    key_t = stream.schema[key].dataType.simpleString()
    schema = f"{key} {key_t}, id bigint, template_id string, state map<string,array<string>>, changed array<string>, template_changed boolean"
    fields = [key, "id", "template_id", "state", "changed", "template_changed"]

    def step(k, frames, held):
        slots, template = held.get if held.exists else (defaults, None)
        slots = {c: list(w) for c, w in dict(slots).items()}
        out = []
        for row in pd.concat(list(frames)).sort_values("id").itertuples(index=False):
            comps = {c: list(w) for c, w in dict(row.components).items() if w is not None and c in defaults}
            slots, changed = apply_to_state(slots, comps)
            out.append((k[0], row.id, row.template_id, slots, changed, row.template_id != template))
            template = row.template_id
        held.update((slots, template))
        yield pd.DataFrame(out, columns=fields)

    return stream.select(key, "id", "template_id", "components").groupBy(key).applyInPandasWithState(
        step, schema, STATE, "append", "NoTimeout"
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str, order: str = "id", **trigger) -> StreamingQuery:
    """Insert-or-ignore of every micro-batch; a replayed batch adds nothing, because its hashes are there."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, order))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dynamics_stream(states: DataFrame, vectors: DataFrame, total, n_centroids: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Metrics of each carried state; ``states`` comes from ``carried_state``, ``vectors`` are static."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.select("id", "state").persist()  # read twice; the states are made once
        rows = dynamics(held, vectors, total, n_centroids)
        # a folder per batch number makes a replay overwrite itself
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    return (
        states.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
