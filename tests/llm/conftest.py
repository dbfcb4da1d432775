import pytest

ODD_TEXTS = [None, "", " ", "\n\n", "one", "a  b\tc", "é ß 日本語", "x" * 70_000, "word " * 20_000, "tie one two three", "tie one two three", "\x1c a", "don't  won't"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, repeated and tied texts, null ids, and extra columns whose names operators use inside."""
    rows = [(k if k % 5 else None, t, "x", k, "y", "z", 1) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[1], rows[1]]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score int, row string, kept string, spans int").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
