"""Tables in versions: parts are written aside and a version names those that count, put in place by one rename.

Layout: ``<path>/_versions/<number>.json`` holds the names of the version's parts, folders of Parquet files under
``path``.  A reader takes the highest number and reads its parts, which no writer changes: half a table is never seen.
Writers that start from the same version collide on the next number; one of them gets :class:`Conflict`.  The rename
must not replace a file that is there, which HDFS and local file systems give; object stores need a committer that does.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer put the next version in place first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: list[str] = field(default_factory=list)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    system, at = _system(spark, f"{path}/{FOLDER}")
    if not system.exists(at):
        return []
    names = [x.getPath().getName() for x in system.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or that of a number; number 0 without parts where there is no table yet."""
    if number is None:
        number = max(_numbers(spark, path), default=0)
    if not number:
        return Version()
    system, at = _system(spark, f"{path}/{FOLDER}/{number:012d}.json")
    stream = system.open(at)
    try:
        return Version(number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"])
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, parts: list[str], after: Version) -> Version:
    """Puts the version after ``after`` in place, of these parts.  The one visible step is a rename."""
    new = Version(after.number + 1, parts)
    system, aside = _system(spark, f"{path}/{FOLDER}/_new-{os.urandom(8).hex()}")
    out = system.create(aside, False)
    out.write(bytearray(json.dumps({"parts": parts}).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(aside), system.makeQualified(hadoop.Path(f"{path}/{FOLDER}/{new.number:012d}.json")), no_options)
    except Exception as e:
        system.delete(aside, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {new.number} of {path} is there") from e
        raise
    return new


def read_version(spark: SparkSession, path: str, at: Version | None = None, base: str | None = None) -> DataFrame:
    """The rows of a version, by default of the newest; ``base`` is the folder that partition columns begin at."""
    at = at or version(spark, path)
    if not at.parts:
        raise ValueError(f"no version of a table at {path}")
    reader = spark.read.option("basePath", base) if base else spark.read
    return reader.parquet(*[f"{path}/{p}" for p in at.parts])


def replace(spark: SparkSession, df: DataFrame, path: str, keep: int = 2) -> Version:
    """``df``, which may read the table itself, as its next version; versions before the last ``keep`` are removed."""
    before = version(spark, path)
    part = f"part-{os.urandom(8).hex()}"
    df.write.parquet(f"{path}/{part}")
    new = commit(spark, path, [part], before)
    clean(spark, path, keep)
    return new


def clean(spark: SparkSession, path: str, keep: int = 2, folders: Callable[[str], list[str]] = lambda part: [part]) -> int:
    """Removes versions before the last ``keep`` and the ``folders`` of parts that only they name; returns how many
    versions went.

    A reader that began before those ``keep`` versions loses its files, so ``keep`` must cover the longest read.
    """
    numbers = _numbers(spark, path)
    old = numbers[: -max(keep, 1)]
    live = {p for n in numbers[len(old) :] for p in version(spark, path, n).parts}
    for n in old:
        gone = [folder for part in set(version(spark, path, n).parts) - live for folder in folders(part)]
        for name in [*gone, f"{FOLDER}/{n:012d}.json"]:
            system, at = _system(spark, f"{path}/{name}")
            system.delete(at, True)
    return len(old)
