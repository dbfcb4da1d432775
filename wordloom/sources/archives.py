"""NumPy archives (``.npz``) of keyed arrays as a Spark data source, for scans and as a sink.

``spark.read.format("npz").load(path)`` gives one row for each member; ``df.write.format("npz").save(path)`` writes an
archive for each task.  Register it once with :func:`register`.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "archive string, ordinal bigint, key string, vector array<double>, text string"
#: Bytes of members that one task reads, unless the option ``bytes`` says otherwise; rows of one batch.
TASK_BYTES, BATCH = 64 << 20, 1024


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def _files(path: str) -> list[str]:
    """The archives of a file, a folder, or several of them parted by commas, by name."""
    out = []
    for p in path.split(","):
        system, inner = fs.FileSystem.from_uri(p.strip())
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.type == fs.FileType.File:
            out.append(p.strip())
        else:
            found = system.get_file_info(fs.FileSelector(inner, recursive=True))
            out += sorted(f"{p.strip().rstrip('/')}/{os.path.relpath(f.path, inner)}" for f in found if f.is_file and f.path.endswith(".npz"))
    return out


def _members(file) -> list[zipfile.ZipInfo]:
    """The arrays of an archive in the order in which they were written."""
    return sorted((i for i in zipfile.ZipFile(file).infolist() if i.filename.endswith(".npy")), key=lambda i: i.header_offset)


@dataclass
class Range(InputPartition):
    """Members ``start`` to ``stop`` of one archive."""

    path: str
    start: int
    stop: int


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, overwrite)


class NpzReader(DataSourceReader):
    """``archive`` is the file's name, ``ordinal`` the member's place in it.  A numeric array is ``vector``, flat; a text
    is ``text``; of arrays of objects, which only code could restore, both are null."""

    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("bytes", TASK_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                sizes = [i.compress_size for i in _members(f)]
            start, held = 0, 0
            for k, n in enumerate(sizes):
                if held and held + n > self.bytes:
                    out.append(Range(path, start, k))
                    start, held = k, 0
                held += n
            if sizes:
                out.append(Range(path, start, len(sizes)))
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, inner = fs.FileSystem.from_uri(part.path)
        with system.open_input_file(inner) as f:
            archive, held = zipfile.ZipFile(f), []
            for k, info in list(enumerate(_members(f)))[part.start : part.stop]:
                vector, text = None, None
                try:
                    array = np.lib.format.read_array(io.BytesIO(archive.read(info)), allow_pickle=False)
                    if array.dtype.kind in "fiub":
                        vector = array.astype(np.float64).ravel()
                    elif array.dtype.kind in "US" and array.size == 1:
                        value = array.ravel()[0]
                        text = value.decode() if isinstance(value, bytes) else str(value)
                except ValueError:
                    pass
                held.append((os.path.basename(part.path), k, info.filename[: -len(".npy")], vector, text))
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.string()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["archive", "ordinal", "key", "vector", "text"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class NpzWriter(DataSourceArrowWriter):
    """Rows of (key, vector[, text]): one archive for each task that has rows.  An archive gets its name when the job
    commits, so archives of tasks that failed or ran twice are never read."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = fs.FileSystem.from_uri(self.path)
        name, out, archive = f"{inner}/.{os.urandom(12).hex()}", None, None
        for b in batches:
            at = {c: b.schema.get_field_index(c) for c in ("key", "vector", "text")}
            for r in range(b.num_rows):
                if archive is None:
                    system.create_dir(inner, recursive=True)
                    out = system.open_output_stream(name)
                    archive = zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                value = b.column(at["vector"])[r] if at["vector"] >= 0 else None
                if value is not None and value.is_valid:
                    array = value.values.to_numpy(zero_copy_only=False)
                else:
                    array = np.array((b.column(at["text"])[r].as_py() if at["text"] >= 0 else None) or "")
                data = io.BytesIO()
                np.lib.format.write_array(data, array, allow_pickle=False)
                archive.writestr(f"{b.column(at['key'])[r].as_py()}.npy", data.getvalue())
        if archive is None:
            return Written(None)
        archive.close()
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = fs.FileSystem.from_uri(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            old = system.get_file_info(fs.FileSelector(inner))
            for f in old:
                if f.is_file and f.path.endswith(".npz"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{inner}/{os.path.basename(m.path)[1:]}.npz")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class _Sink:
    """A stream that cannot seek, as the ZIP writer wants it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass
