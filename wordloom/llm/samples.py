"""Bounded, repeatable samples of labelled texts to fit classifiers on, and small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, divisor: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % divisor == rest, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled ids of each class, those of the least hashes, in that order.

    ``per_class`` rows of each class bound what the driver gets; texts are whole.  The ids are chosen from the
    labels, so only their texts are joined.  Null ids, labels other than 0 and 1 and null texts take no part.
    """
    marks = labels.where(keep).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL").distinct()
    order = F.xxhash64("i")
    chosen = [marks.where(F.col("y") == c).orderBy(order, "i").limit(per_class) for c in (1, 0)]
    texts = documents.select(documents[id_col].alias("i"), documents[text_col].cast("string").alias("t"))
    found = texts.join(F.broadcast(chosen[0].union(chosen[1])), "i").where("t IS NOT NULL").select("i", "t", "y")
    # An id with several rows has each of them once, as far as the bound goes.
    rows = [r for c in (1, 0) for r in found.where(F.col("y") == c).orderBy(order, "i", F.xxhash64("t"), "t").limit(per_class).collect()]
    rows.sort(key=lambda r: (r["i"], r["t"]))
    mixed = np.random.default_rng(7).permutation(len(rows))
    return [(rows[k]["t"], rows[k]["y"]) for k in mixed]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights, the last one constant, by Newton steps; one class only gives its own constant."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    if not len(x):
        return w
    n = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))
