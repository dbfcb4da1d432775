import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.plans.batch import emit
from wordloom.sources import archives as AR
from wordloom.sources import pools as SP
from wordloom.sources import vectors as SV


@pytest.fixture()
def npz(spark):
    AR.register(spark)
    return lambda path, **options: spark.read.format("npz").options(**options).load(str(path))


def test_archives_of_numpy_are_read(npz, tmp_path):
    members = {"a/x/clip": np.arange(3, dtype=np.float32), "a/x/t5": np.ones((1, 4)), "a/y z/w/clip": np.array([1, 2]), "_metadata_json": np.array('{"t5_model": "m"}')}
    np.savez(tmp_path / "one.npz", **members)
    np.savez_compressed(tmp_path / "two.npz", **{"b/q/clip": np.zeros(2), "odd": np.array([{1}], dtype=object), "n": np.array(["a", "b"])})
    rows = {(r.archive, r.key): r for r in npz(tmp_path, bytes="1").collect()}
    assert len(rows) == 7
    assert [rows["one.npz", k].vector for k in members] == [[0, 1, 2], [1, 1, 1, 1], [1, 2], None]
    assert [rows["one.npz", k].ordinal for k in members] == [0, 1, 2, 3]
    assert rows["one.npz", "_metadata_json"].text == '{"t5_model": "m"}'
    assert rows["two.npz", "odd"].vector is None and rows["two.npz", "odd"].text is None and rows["two.npz", "n"].text is None
    a = {(r.category, r.word): r for r in SV.by_category(npz(tmp_path / "one.npz")).collect()}
    assert a["a", "x"].semantic == [1, 1, 1, 1] and a["a", "y z/w"].visual == [1, 2] and a["a", "y z/w"].semantic is None
    assert npz(f"{tmp_path}/one.npz,{tmp_path}/two.npz").count() == 7


def test_a_large_archive_is_read_in_ranges(spark, npz, tmp_path):
    np.savez(tmp_path / "many.npz", **{f"c/w{k}/clip": np.full(64, k, float) for k in range(500)})
    df = npz(tmp_path / "many.npz", bytes="20000")
    assert df.rdd.getNumPartitions() > 10
    assert sorted((r.ordinal, r.vector[0]) for r in df.collect()) == [(k, float(k)) for k in range(500)]


def test_round_trip_and_overwrite(spark, npz, tmp_path):
    rows = spark.createDataFrame([(f"c/w{k}/clip", [float(k), 2.0], None) for k in range(40)] + [("_note", None, "é")], "key string, vector array<double>, text string")
    path = str(tmp_path / "out")
    rows.repartition(4).write.format("npz").mode("append").save(path)
    got = {r.key: (r.vector, r.text) for r in npz(path).collect()}
    assert got == {r.key: (r.vector, r.text) for r in rows.collect()}
    files = list((tmp_path / "out").glob("*.npz"))
    with np.load(files[0]) as one:
        assert all(one[k].shape == (2,) for k in one.files if k != "_note")
    rows.filter("key = 'c/w1/clip'").write.format("npz").mode("overwrite").save(path)
    assert npz(path).count() == 1 and not list((tmp_path / "out").glob(".*"))


def test_an_empty_folder_and_a_missing_one(npz, tmp_path):
    (tmp_path / "none").mkdir()
    assert npz(tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="gone"):
        npz(tmp_path / "gone").count()


def test_pool_and_template_files_round_trip(spark, tmp_path):
    rows = [("p", "b", 2, 'say "hi": é', None), ("p", "a", 5, "- x", "no x"), ("p", "a", 1, "y", ""), ("q", "a", 1, "null", "true")]
    df = spark.createDataFrame(rows, "pool string, category string, ordinal long, word string, opposite string")
    listed = {r.pool: r.words for r in SP.write_pool_files(df, str(tmp_path / "pools")).collect()}
    assert listed == {"p": 3, "q": 1}
    got = sorted(tuple(r) for r in SP.read_pools(spark, str(tmp_path / "pools" / "*.yaml")).collect())
    assert got == [("p", "a", 0, "y", ""), ("p", "a", 1, "- x", "no x"), ("p", "b", 2, 'say "hi": é', None), ("q", "a", 0, "null", "true")]
    t = spark.createDataFrame([("t1", "{a:2:, } of {b}", ["a", "b"], None), ("t2", "x: y", [], "n")], SP.TEMPLATES)
    SP.write_template_files(t, str(tmp_path / "templates"), 3)
    back = {r.id: r for r in SP.read_templates(spark, str(tmp_path / "templates")).collect()}
    assert back["t1"].structure == "{a:2:, } of {b}" and back["t1"].required_components == ["a", "b"] and back["t2"].notes == "n"


def test_prompts_are_emitted_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "one", {"c": ["x", "y"]}), (2, "two", {})], "prompt_no long, positive string, components map<string,array<string>>")
    emit(df, str(tmp_path / "json"), "json")
    back = spark.read.schema(df.schema).json(str(tmp_path / "json"))
    assert {r.prompt_no: r.components for r in back.collect()} == {1: {"c": ["x", "y"]}, 2: {}}
    emit(df, str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).select(F.col("value")).collect()) == ["one", "two"]


def test_pool_files_are_read_item_by_item():
    """The rows are those of the loaded file, and no file is held as objects."""
    import tracemalloc

    import yaml

    def loaded(text):
        data = yaml.safe_load(text) or {}
        lists = {c: x for c, x in (data.get("components", data) or {}).items() if x and isinstance(x, list)}
        keyed = {c: isinstance(x[0], dict) for c, x in lists.items()}
        return [(str(c), str(i["word"] if keyed[c] else i), i.get("opposite") if keyed[c] else None) for c, x in lists.items() for i in x]

    odd = [
        "", "components:\n", "components: {}\nother: [x]\n", "a: [x]\n1: [y, z]\nb: {c: d}\nc: []\n",
        "components:\n  a: [x, 1.0, null, yes, 'q']\n  b:\n    - word: z\n      opposite: w\n    - word: k\n",
        "components:\n  a: [x]\n  a: [y, z]\n", "x: &x [p, q]\ncomponents:\n  a: *x\n  b: [r]\n", "components:\n  a: [&w one, two]\n  b: [*w]\n",
        "base: &b\n  a: [1]\ncomponents:\n  <<: *b\n  c: [2]\n", "base: &b\n  - word: p\ncomponents:\n  a: [&i {word: s}, *i]\n",
    ]
    for text in odd:
        assert list(SP._items(text)) == loaded(text), text
    long = "components:\n  a:\n" + "".join(f"    - word: w{i}\n      opposite: o{i}\n" for i in range(5000))
    tracemalloc.start()
    assert sum(1 for _ in SP._items(long)) == 5000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
