"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Stream state beyond an executor's memory goes to its disk and, by checkpoint, to the shared folder.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # A batch of 2k rows x 1k doubles is 16 MB, which a Python worker holds with ease.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; taken from the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return named or current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Tasks to use for work that is heavy for its bytes: what the session asks for, and all cores at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-row work on a scan of fewer partitions than cores.

    A scan of many files has partitions enough and passes through; only a small input is shuffled.  Plans
    with an exchange pass through too, because counting their partitions would run them.
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def grouped(df: DataFrame, keys: list[str]):
    """``groupBy`` whose groups spread over all tasks.

    Kernels are heavy for the bytes they read, and adaptive execution would merge small partitions into
    one task; an explicit number of partitions is kept, and the grouping needs no second exchange.
    """
    return df.repartition(width(df.sparkSession), *keys).groupBy(*keys)
