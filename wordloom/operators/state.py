"""Carried visual state per key, and metrics of each state."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions.presets import INITIAL_STATE, features
from ..functions.text import occurrences
from ..functions.vectors import pole
from . import tiles as T
from .moments import centroids
from .ordered import CHUNK_ROWS, last_before

# Metrics of a prompt none of whose words has a vector.
DEFAULT_ENERGY, DEFAULT_TENSION, DEFAULT_VOID = 0.45, 0.0, 0.5
WORDS = "array<string>"


def _slot(i: int) -> str:
    return f"_slot{i}"


def carry_forward(prompts: DataFrame, key: list[str], order: str = "id", defaults: dict[str, list[str]] = INITIAL_STATE,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """State after every prompt: each category keeps its latest words, or its default before the first.

    ``prompts`` has the ``key`` columns, a unique ``order`` column and ``components`` (map of word lists).
    Adds ``state`` and ``changed``: the categories whose words differ from the state before, sorted.
    """
    cats = list(defaults)
    df = prompts.withColumns({_slot(i): F.try_element_at("components", F.lit(c)) for i, c in enumerate(cats)})
    df = last_before(df, key, order, [_slot(i) for i in range(len(cats))], "_b", chunk_rows)
    before = [F.coalesce(F.col("_b" + _slot(i)), F.lit(defaults[c]).cast(WORDS)) for i, c in enumerate(cats)]
    now = [F.coalesce(F.col(_slot(i)), b) for i, b in enumerate(before)]
    state = F.create_map(*[x for c, n in zip(cats, now) for x in (F.lit(c), n)])
    flags = [F.when(F.col(_slot(i)).isNotNull() & (F.col(_slot(i)) != b), F.lit(c)) for i, (c, b) in enumerate(zip(cats, before))]
    changed = F.array_sort(F.array_compact(F.array(*flags)))
    drop = [p + _slot(i) for i in range(len(cats)) for p in ("", "_b")]
    return df.withColumns({"state": state, "changed": changed}).drop(*drop)


# ---- reading a state map --------------------------------------------------------------------------


def slot(state: Column, category: str) -> Column:
    default = F.lit(INITIAL_STATE.get(category, [])).cast(WORDS)
    return F.coalesce(F.try_element_at(state, F.lit(category)), default)


def slot_word(state: Column, category: str) -> Column:
    return F.coalesce(F.get(slot(state, category), F.lit(0)), F.lit(""))


def state_words(state: Column) -> Column:
    return F.flatten(F.map_values(state))


def filled_categories(state: Column) -> Column:
    return F.map_keys(F.map_filter(state, lambda _, v: F.size(v) > 0))


def feature_rows(states: DataFrame) -> DataFrame:
    """Derived features of each state; ``states`` has ``state`` and ``template_id``."""
    return states.withColumns(features(F.col("state"), F.col("template_id")))


# ---- metrics --------------------------------------------------------------------------------------


def centroid_total(members: DataFrame) -> tuple[list[float] | None, int]:
    """Sum of the category centroids and their number: two small values the mean similarity needs."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    c = centroids(members.select("category", "ordinal", "visual", "semantic"), ["category"])
    row = c.select(Summarizer.metrics("sum", "count").summary(array_to_vector("visual")).alias("s")).first()
    n = int(row.s["count"]) if row else 0
    return (row.s["sum"].toArray().tolist() if n else None), n


STACK_DOUBLES = 4 << 20  # vectors and similarities that are worked on at once (32 MB)


def with_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """``words`` joined with the other columns of ``vectors`` by ``word``.

    There are many more words than the tables they come from let a plan guess, and a stream's plan is never measured; so
    the words are not sent to all tasks, and the vectors only where they are measured to be small.
    """
    lists = [f.name for f in vectors.schema.fields if f.dataType.typeName() == "array"]
    size = F.lit(64) + sum([8 * F.greatest(F.size(c), F.lit(0)) for c in lists], F.octet_length("word"))  # with a row's own overhead
    held = vectors.agg(F.sum(size)).first()[0] or 0
    return words.join(F.broadcast(vectors) if held <= T.BROADCAST_BYTES else vectors.hint("merge"), "word")


def dynamics(states: DataFrame, vectors: DataFrame, total: list[float] | None, n_centroids: int, id: str = "id") -> DataFrame:
    """Energy, tension, distance from the centroids and poles of each state.

    ``states`` has ``id`` and ``state``; ``vectors`` has ``word`` and ``visual``.  Words without a vector do
    not count.  Energy is 1 - mean pair similarity, tension the greatest similarity across categories, and
    the void metric 1 - the mean similarity of the mean vector to all centroids.
    """
    slots = states.select(id, F.explode("state").alias("category", "words"))
    flat = slots.select(id, "category", F.posexplode("words").alias("place", "word"))
    found = with_vectors(flat, vectors.select("word", "visual"))
    # one entry per word of one prompt
    packed = found.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("category", "place", "visual"))).alias("v"))
    rows = states.select(id).join(packed, id, "left")
    total_v = None if total is None else np.asarray(total)
    schema = f"{id} {states.schema[id].dataType.simpleString()}, n_words int, energy double, tension double, void_proximity double"

    def measure(batches):
        for b in batches:
            out = np.tile([DEFAULT_ENERGY, DEFAULT_TENSION, DEFAULT_VOID], (b.num_rows, 1))
            counts = np.zeros(b.num_rows, np.int32)
            lists = A.plain(b.column(1))
            offs = lists.offsets.to_numpy()
            inner = lists.values
            cats = inner.field("category").to_numpy(zero_copy_only=False)
            vecs, _ = A.matrix(inner.field("visual"))
            counts[:] = np.where(np.asarray(lists.is_valid()), np.diff(offs), 0)
            codes = np.unique(cats, return_inverse=True)[1] if len(cats) else np.zeros(0, np.int64)
            for n in np.unique(counts[counts > 0]):  # states of equal size are one stack of matrices
                rows_n = np.flatnonzero(counts == n)
                step = max(1, STACK_DOUBLES // int(n * (vecs.shape[1] + n)))
                for s in range(0, len(rows_n), step):
                    r = rows_n[s : s + step]
                    at = offs[r][:, None] + np.arange(n)
                    v, c = vecs[at], codes[at]
                    if n >= 2:
                        sim = v @ v.transpose(0, 2, 1)
                        own = np.trace(sim, axis1=1, axis2=2)
                        out[r, 0] = np.clip(1.0 - (sim.sum(axis=(1, 2)) - own) / (n * (n - 1)), 0.0, 1.0)
                        most = np.where(c[:, :, None] != c[:, None, :], sim, -np.inf).max(axis=(1, 2))
                        out[r, 1] = np.where(np.isfinite(most), np.clip(most, 0.0, 1.0), DEFAULT_TENSION)
                    mean = v.mean(axis=1)
                    size = np.linalg.norm(mean, axis=1)
                    if total_v is not None and n_centroids:
                        away = 1.0 - (mean @ total_v) / np.where(size > 0, size, 1.0) / n_centroids
                        out[r, 2] = np.where(size > 0, np.clip(away, 0.0, 1.0), out[r, 2])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts), *[pa.array(out[:, i]) for i in range(3)]],
                names=[id, "n_words", "energy", "tension", "void_proximity"],
            )

    return rows.select(id, "v").mapInArrow(measure, schema)


def gravity_poles(states: DataFrame, vectors: DataFrame, id: str = "id") -> DataFrame:
    """Direction of the first three entries of every word's vector, one row per word of a state."""
    order = F.map_from_arrays(F.lit(list(INITIAL_STATE)), F.sequence(F.lit(0), F.lit(len(INITIAL_STATE) - 1)))
    slots = states.select(id, F.explode("state").alias("category", "words"))
    flat = slots.select(id, "category", F.try_element_at(order, F.col("category")).alias("slot_no"), F.posexplode("words").alias("place", "word"))
    p = pole(F.col("visual"))
    poles = vectors.filter(F.size("visual") >= 3).select("word", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))
    return with_vectors(flat, poles).select(id, "category", "slot_no", "place", "word", "x", "y", "z")


def spans(texts: DataFrame, id: str = "id") -> DataFrame:
    """Where the words of each category occur in the text: (category, word, start, end), end exclusive.

    ``texts`` has ``text`` and ``components``.
    """
    words = texts.select(id, "text", F.explode("components").alias("category", "words"))
    each = words.select(id, "text", "category", F.explode("words").alias("word"))
    hits = each.select(id, "category", "word", F.explode(occurrences(F.col("text"), F.col("word"))).alias("start"))
    return hits.withColumn("end", F.col("start") + F.length("word"))


def apply_to_state(state: dict, components: dict) -> tuple[dict, list]:
    """One prompt applied to one state: the new state and the changed categories (sorted)."""
    changed = sorted(c for c, w in components.items() if w is not None and list(state.get(c, [])) != list(w))
    return {**state, **{c: list(components[c]) for c in changed}}, changed


def state_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)
