"""WARC records in ZIP packages, read in ranges.

A package holds the stored members ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (a line for each record: offset and length in the WARC member).  The reader parses the end
record, the ZIP64 records and the central directory, then reads records by their ranges; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_folder, storage, written

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A package is closed once its records hold this many bytes.
PACKAGE_BYTES = 128 << 20
#: Neighbouring records are read together up to this many bytes.
READ_BYTES = 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one response, or of one revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; the payload of a response is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) else None
    kind, want = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (digest(payload) != want or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest or length")
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "payload_digest": want,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


@dataclass
class Member:
    """A stored member: where its bytes lie in the package."""

    name: str
    offset: int
    size: int


class Package:
    """A ZIP file opened for range reads.  ``file`` has ``seek``, ``read`` and ``size()``."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail_at = max(0, size - 65557)  # the end record and the longest comment
        tail = self._read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06", 0, len(tail) - 18)  # an end record has 22 bytes at least
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP package: no end record")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail_at + end >= 20:
            sign, _, at, _ = struct.unpack("<4sIQI", self._read(tail_at + end - 20, 20))
            if sign == b"PK\x06\x07":
                whole = self._read(at, 56)
                if whole[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 end record is missing")
                count, length, start = struct.unpack_from("<QQQ", whole, 32)
        self.members = {m.name: m for m in self._directory(self._read(start, length), count)}

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self, data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, size, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", data, at + 20)
            local, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + name_n].decode()
            extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                extra = extra[4 + n :]
            at += 46 + name_n + extra_n + note_n
            if method == 0 and packed == size:
                yield Member(name, local, size)
            elif re.match("archive/|indexes/", name):
                raise ValueError(f"{name} is compressed in the package; ranges need stored members")

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """``n`` bytes of a member from ``at`` on."""
        m = self.members[name]
        head = self._read(m.offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        begin = m.offset + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self._read(begin + at, min(m.size - at, m.size if n is None else n))

    def records(self, archive: str = "archive/data.warc.gz", index: str = "indexes/index.cdxj") -> Iterator[dict]:
        """All indexed records; neighbouring ranges are read at once."""
        spans = [(x["offset"], x["length"]) for x in map(json.loads, self.read(index).splitlines())]
        at = 0
        while at < len(spans):
            to, (begin, n) = at + 1, spans[at]
            while to < len(spans) and spans[to][0] == begin + n and n + spans[to][1] <= READ_BYTES:
                n += spans[to][1]
                to += 1
            data = self.read(archive, begin, n)
            for o, k in spans[at:to]:
                yield parse_record(gzip.decompress(data[o - begin : o - begin + k]))
            at = to


def write_package(system, path: str, rows: Iterator[tuple]) -> int:
    """Records of (page, url, payload, refers_to) up to ``PACKAGE_BYTES``; returns how many were written."""
    lines, at = [], 0
    with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True) as member:
            for page, url, payload, refers_to in rows:
                data = gzip.compress(record(page, url, payload, refers_to), 6, mtime=0)
                member.write(data)
                lines.append(json.dumps({"page": page, "offset": at, "length": len(data)}))
                at += len(data)
                if at >= PACKAGE_BYTES:
                    break
        z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "\n".join(lines))
    return len(lines)


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes packages to the shared folder and returns their list (path, records), itself a written table.

    Of records with equal payloads of ``min_bytes`` or more, those with the largest id are responses and the others
    revisit it.  A null html is an empty payload; a null id is no one's response, and a response itself if all ids of
    its payload are null; rows repeated in full each get a record.  An empty table gives an empty list.
    A task that is run again writes new packages under other names; only listed packages count.
    """
    spark = pages.sparkSession
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.sha1("payload"))
    # The greatest id of each payload: partial maxima meet, so a payload of many pages is no hot key here.  They are
    # written, so that the join back has a bare exchange on either side, and adaptive execution splits a hot payload.
    first = written(rows.groupBy("key").agg(F.max("id").alias("first")), "firsts")
    refers = F.when((F.octet_length("payload") >= min_bytes) & (F.col("id").isNull() | (F.col("id") < F.col("first"))), F.col("first"))
    joined = rows.join(first, "key").select("id", "url", "payload", refers.alias("refers_to"))
    folder = shared_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = storage(folder)
        rows = (
            (r["id"], r["url"], r["payload"], r["refers_to"])
            for b in bounded(batches, "payload")
            for r in b.to_pylist()
        )
        for one in rows:
            name = f"{os.urandom(12).hex()}.wacz"
            n = write_package(system, f"{inner}/{name}", (x for part in ([one], rows) for x in part))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return written(joined.mapInArrow(run, "path string, records long"), "warc-list")


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of all packages of a list with a column ``path``: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload (null for revisits).  A package that is damaged fails the job."""
    n = max(1, min(packages.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                system, inner = storage(path)
                with system.open_input_file(inner) as f:
                    held, size = [], 0
                    for r in Package(f).records():
                        held.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, kinds)

    out = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return packages.select("path").repartition(n).mapInArrow(run, out)
