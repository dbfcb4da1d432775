import os
import sys

import numpy as np
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from helpers import unit_rows, vector_frame  # noqa: E402
from wordloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pool(spark):
    """Three categories of 40, 25 and 7 words, in a shuffled order of rows; returns (frame, arrays per category)."""
    arrays, rows, at = {}, [], 0
    for c, n in (("a", 40), ("b", 25), ("c", 7)):
        v, s = unit_rows(n, 6, at + 1), unit_rows(n, 5, at + 2)
        arrays[c] = (np.arange(at, at + n), v, s)
        rows += [(c, at + i, f"{c}{i}", v[i], s[i]) for i in range(n)]
        at += n
    np.random.default_rng(9).shuffle(rows)
    return vector_frame(spark, rows).cache(), arrays
