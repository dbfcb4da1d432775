"""Run a stream over what is there now and hand back the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path


def file_stream(spark: SparkSession, folder: str, name: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` picks one table of a folder of many: a file, or a folder of files."""
    path = f"{folder}/{name}" if name else folder
    now = spark.read.parquet(path)
    schema = now.schema
    if name and any(f.rstrip("/").rsplit("/", 1)[-1] != name for f in now.inputFiles()):
        folder, name = path, None  # the table is a folder: its files have names of their own
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name:
        r = r.option("pathGlobFilter", name)
    return r.parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available and read the written rows back.

    Append output goes to files.  Update and complete output is written per micro-batch, and the rows of
    the last micro-batch that produced any are returned (complete mode).
    """
    spark = stream.sparkSession
    out, mark = fresh_path(spark, "stream"), fresh_path(spark, "progress")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append")
    else:
        q = (
            stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out))
            .option("checkpointLocation", mark)
            .outputMode(mode)
        )
    run = q.trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
