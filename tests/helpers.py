"""What several test modules share besides fixtures."""

import numpy as np

DATA = "/root/testdata/sf0.001"

SCHEMA = "category string, ordinal bigint, word string, visual array<double>, semantic array<double>"


def unit_rows(n, d, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_frame(spark, rows):
    """rows: (category, ordinal, word, visual, semantic or None)."""
    clean = [(c, int(o), w, [float(x) for x in v], None if s is None else [float(x) for x in s]) for c, o, w, v, s in rows]
    return spark.createDataFrame(clean, SCHEMA)
