"""Steps whose memory, shuffle or rounds must not grow faster than their input."""

import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from helpers import unit_rows, vector_frame
from wordloom.operators import selection as S
from wordloom.operators.nearest import _best
from wordloom.operators.probes import jitter
from wordloom.sources import pools as SP
from wordloom.streaming.runs import drain, file_stream


def test_nearest_rows_take_no_memory_for_all_similarities():
    rng = np.random.default_rng(3)
    base, q = rng.normal(size=(20000, 8)), rng.normal(size=(3000, 8))
    base[5] *= 20
    base[9000] = base[5]  # an equal later row is no better
    q[0] = base[5]
    ords = np.arange(0, 40000, 2)
    skip = np.concatenate([[10], rng.integers(0, 40000, 2999)])
    tracemalloc.start()
    sim, at = _best(q, base, ords, skip)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all similarities are 480 MB
    plain = q @ base.T
    plain[skip[:, None] == ords[None, :]] = -np.inf
    assert at[0] == 9000 and (at == plain.argmax(1)).all()
    assert np.allclose(sim, plain.max(1))
    assert _best(q, base, ords)[1][0] == 5


def test_a_cloud_around_few_centres_is_spread_over_tasks(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id bigint, vector array<double>").coalesce(1)
    assert jitter(few, (0.3,), 500).select(F.spark_partition_id()).distinct().count() == 1
    cloud = jitter(few, (0.3,), 500, parts=8)
    assert cloud.select(F.spark_partition_id()).distinct().count() == 8
    assert sorted(cloud.collect()) == sorted(jitter(few, (0.3,), 500).collect())


def test_large_groups_are_walked_in_one_task_without_rounds(spark, monkeypatch):
    v, u = unit_rows(60, 6, 1), unit_rows(60, 5, 2)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], u[i]) for i in range(60)])
    want = S.diverse_words(df, 9).select("ordinal", "rank").collect(), S.elbow(df, 12).collect()
    monkeypatch.setattr(S, "SMALL_GROUP", 16)
    monkeypatch.setattr(S, "_diverse_rounds", None)  # the rounds are not needed
    assert sorted(S.diverse_words(df, 9, small=16).select("ordinal", "rank").collect()) == sorted(want[0])
    assert S.elbow(df, 12, small=16).collect() == want[1]


def test_a_table_of_many_files_is_streamed_by_its_name(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/other.parquet")
    assert drain(file_stream(spark, str(tmp_path), "t.parquet")).count() == 10


def test_template_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SP, "TEMPLATES_A_FILE", 5)
    rows = [(f"t{i}", f"a {{x}} {i}", ["x"], "") for i in range(60)]
    SP.write_template_files(spark.createDataFrame(rows, SP.TEMPLATES), f"{tmp_path}/t", 2)
    back = SP.read_templates(spark, f"{tmp_path}/t")
    assert len(back.inputFiles()) > 6
    assert sorted((r.id, r.structure) for r in back.collect()) == sorted(r[:2] for r in rows)


def test_small_tiles_do_not_multiply_the_rows(spark):
    from wordloom.operators import tiles as T
    from wordloom.operators.cells import Cells

    v = unit_rows(800, 16, 5)
    df = vector_frame(spark, [("a", i, f"w{i}", v[i], None) for i in range(800)])
    assert T.self_tiles(df, [], "ordinal", 8).count() <= 800 * (T.MANY_TILES + 1)
    # vectors without structure: every cell may hold a similar row, and visits by cell would be 100 a row
    assert Cells(df, "ordinal", rows=8).tiles(df, [], "visual", 0.3).count() <= 800 * (T.MANY_TILES + 1)


def test_pair_statistics_write_each_row_once(spark, tmp_path, monkeypatch):
    """Tiles are files that the tasks of their pairs read, not rows laid out once for every pair."""
    import pyarrow as pa
    from wordloom.operators import tiles as T
    from wordloom.operators.pairs import pair_stats

    v = unit_rows(90, 4, 3)
    df = vector_frame(spark, [("ab"[i >= 80], i, f"w{i}", v[i], v[i]) for i in range(90)])
    monkeypatch.setattr(T, "fresh_path", lambda spark, name: str(tmp_path / name))
    got = {r.category: r for r in pair_stats(df, ["category"], ["visual"], rows=16).collect()}
    assert got["a"].pairs == 80 * 79 // 2 and got["b"].pairs == 10 * 9 // 2
    held = [pa.ipc.open_file(str(f)).read_all().num_rows for f in (tmp_path / "tiles").iterdir()]
    assert len(held) == 5 and sum(held) == 80
