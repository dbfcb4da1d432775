"""Kernels travel by value: workers that cannot import the package run every operator."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from wordloom.session import build_session
from wordloom.llm.queries import QUERIES
spark = build_session("elsewhere", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
def can_import(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("wordloom") is not None])], ["there"])
assert not spark.range(1).mapInArrow(can_import, "there boolean").first().there
for name in sorted(QUERIES):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_every_query_runs_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) >= 13
