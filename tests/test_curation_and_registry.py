import glob
import os

import duckdb
import pytest
from helpers import DATA

import __spark_entry__ as entry
from check_oracle import canonical
from wordloom.operators import curation as CU


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_curation_rules(spark):
    pool = frame(spark, [("a", 0, "keep"), ("a", 1, "trash"), ("a", 2, "mv"), ("b", 3, "mv"), ("a", 4, "dup1"), ("b", 5, "dup2"), ("a", 6, "mv2"), ("c", 7, "bad")], "category string, ordinal bigint, word string")
    w = "word string"
    rules = CU.Rules(
        frame(spark, [("trash",)], w),
        frame(spark, [("bad",)], w),
        frame(spark, [("mv", "a", "b"), ("mv2", "a", "new"), ("keep", "z", "b")], "word string, from_category string, to_category string"),
        frame(spark, [("absent", "dup1"), ("keep", "dup2")], "keep string, drop string"),
        frame(spark, [("a", "back", 0), ("b", "back", 1), ("c", "keep", 2), ("b", "unknown", 3), ("zz", "lost", 4)], "category string, word string, place bigint"),
    )
    original = frame(spark, [("a", "back"), ("b", "back"), ("c", "keep"), ("zz", "lost")], "category string, word string")
    got = sorted((r["category"], r["word"]) for r in CU.curate(pool, rules, original).collect())
    assert got == [("a", "back"), ("a", "keep"), ("b", "mv"), ("new", "mv2")]
    strict = {r["word"] for r in CU.curate(pool, rules, original, require_keep=True).collect()}
    assert "dup1" in strict and "dup2" not in strict
    log = {(r["step"], r["word"]) for r in CU.curation_log(pool, rules, original).collect()}
    assert log == {("garbage", "trash"), ("remove", "bad"), ("move", "mv"), ("move", "mv2"), ("duplicate", "dup1"), ("duplicate", "dup2"), ("restore", "back")}


QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_registered_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    rel = con.sql(SQL[name])
    heads = rel.columns
    assert cols == sorted(heads)
    order = [heads.index(c) for c in cols]
    assert got == sorted(tuple(canonical(r[i]) for i in order) for r in rel.fetchall())
