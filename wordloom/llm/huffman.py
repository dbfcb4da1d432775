"""Token ids in files of canonical, length-limited Huffman codes.

A file holds the documents of one range of ids: blocks of whole-token bits, each with its own start and a bit offset
every ``STEP`` ids, so that blocks are read alone and all stretches between checkpoints are decoded side by side, each
id by one look into a table of ``2 ** MAX_BITS`` entries.  Codes follow from their lengths, which come from the counts
of all ids of all documents.

File: ``TIDS``, version, bits of the longest code; then blocks; then a footer (JSON, gzip) with the documents' ids and
token counts and each block's place; last, the footer's length and ``TIDS``.  Integers are little-endian.
"""

from __future__ import annotations

import gzip
import heapq
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import packed
from .common import bounded, once, shared_folder, storage, two, written
from .tokens import TOKEN_BATCH, Words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MAX_BITS, BLOCK, STEP, END = 16, 1 << 18, 512, 0
MAGIC = b"TIDS"


def _words(path: str) -> Words:
    def make() -> Words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def encode(texts: list[str]) -> list[list[int]]:
            # The library's results hold far more than ids; a few at a time are kept.
            return [x.ids for k in range(0, len(texts), 256) for x in t.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]

        # Byte-level vocabularies write a space as U+0120.
        vocab = t.get_vocab()
        spaced = np.zeros(max(vocab.values()) + 1, bool)
        spaced[[k for token, k in vocab.items() if token.startswith("\u0120")]] = True
        return Words(encode, whole=tuple(x.content for x in t.get_added_tokens_decoder().values()), spaced=spaced)

    return once(f"huffman-words-{path}", make)


def width(path: str) -> int:
    """Bytes of an id between the passes: 2 if the vocabulary allows."""
    from tokenizers import Tokenizer

    return once(f"huffman-width-{path}", lambda: 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4)


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """(id, n_tokens, ids): the ids of every whole text and the end id; null and empty texts have the end id only.

    ``ids`` are little-endian unsigned integers of :func:`width` bytes in a binary value.
    """
    key, kind = df.schema[id_col].dataType, f"<u{width(tokenizer)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for b in bounded(batches, "text", TOKEN_BATCH):
            ids, counts = words.encode_texts(b.column(1))
            ids = np.insert(ids, np.cumsum(counts), end)
            counts = counts + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), packed(ids, counts, kind)], ["id", "n_tokens", "ids"])

    return two(df, id_col, text_col).mapInArrow(run, f"id {key.simpleString()}, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs.  A task adds up its own ids, partial sums meet by id; the result has a row for each id
    of the vocabulary at most, which bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in rows.collect()}


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Huffman lengths of at most ``limit`` bits: while too many codes are long, the rarest counts are raised and the
    tree is built anew; with all counts equal it is balanced, so the limit must hold 2 ** limit >= symbols."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    if len(counts) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    floor = 1
    while True:
        nodes = [(max(n, floor), k) for k, (_, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(nodes)
        parent: dict[int, int] = {}
        serial = len(nodes)
        while len(nodes) > 1:
            (w1, a), (w2, b) = heapq.heappop(nodes), heapq.heappop(nodes)
            parent[a] = parent[b] = serial
            heapq.heappush(nodes, (w1 + w2, serial))
            serial += 1
        depth = {serial - 1: 0}
        for k in range(serial - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        symbols = sorted(counts)
        found = {s: depth[k] for k, s in enumerate(symbols)}
        if max(found.values()) <= limit:
            return found
        floor *= 2


class Code:
    """Canonical codes from lengths: shorter codes first, ids ascending within a length."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        self.bits = max(lengths.values(), default=1)
        n = max(lengths, default=0) + 1
        self.code, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint8)
        at = 0
        for s, k in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
            span = 1 << (self.bits - k)
            self.code[s], self.size[s] = at >> (self.bits - k), k
            self.symbol[at : at + span], self.length[at : at + span] = s, k
            at += span

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, the bit offset of every ``STEP``-th id); the bits have eight bytes of padding."""
        size = self.size[ids]
        ends = np.cumsum(size)
        starts = ends - size
        words = np.zeros((int(ends[-1]) >> 5) + 4 if len(ids) else 4, np.uint64)
        shifted = self.code[ids] << (np.uint64(64) - (starts & 31).astype(np.uint64) - size.astype(np.uint64))
        at = starts >> 5
        # The codes' bits are apart, so sums are unions; a stretch of equal `at` is summed at once.
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        if len(ids):
            words[at[cuts]] += np.add.reduceat(shifted >> np.uint64(32), cuts)
            words[at[cuts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), cuts)
        return words.astype(">u4").tobytes(), starts[::STEP].copy()

    def decode(self, data: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """``n`` ids: all stretches between checkpoints step by step together."""
        bits = np.frombuffer(data, np.uint8)
        out = np.zeros((len(checkpoints), STEP), np.uint32)
        at = checkpoints.astype(np.int64).copy()
        drop = np.uint64(64 - self.bits)
        # 64 bits from every byte on would be eight copies; three reads of 4 bytes are enough and small.
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        last = len(bits) // 4 - 3
        for k in range(min(STEP, n)):
            w = np.minimum(at >> 5, last)
            s = (at & 31).astype(np.uint64)
            window = (((words[w] << np.uint64(32)) | words[w + 1]) << s) | ((words[w + 2] << s) >> np.uint64(32))
            look = (window >> drop).astype(np.int64)
            out[:, k] = self.symbol[look]
            at += self.length[look]
        return out.reshape(-1)[:n]


def _write(system, path: str, code: Code, kind: str, rows: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """One file of documents in the given order; returns (documents, tokens).  Memory: a block and the footer."""
    docs, sizes, blocks, held, n_held, total = [], [], [], [], 0, 0
    with system.open_output_stream(path) as out:
        out.write(MAGIC + struct.pack("<BB", 1, code.bits))
        at = 6

        def flush(ids: np.ndarray):
            nonlocal at
            data, marks = code.encode(ids)
            head = marks.astype("<u4").tobytes()
            out.write(head + data)
            blocks.append([at, len(ids), len(marks), len(data)])
            at += len(head) + len(data)

        for doc, packed_ids in rows:
            ids = np.frombuffer(packed_ids, kind)
            docs.append(doc)
            sizes.append(len(ids))
            total += len(ids)
            held.append(ids)
            n_held += len(ids)
            while n_held >= BLOCK:
                joined = np.concatenate(held)
                flush(joined[:BLOCK])
                held, n_held = [joined[BLOCK:]], n_held - BLOCK
        if n_held:
            flush(np.concatenate(held))
        lengths = sorted(code.lengths.items())
        foot = gzip.compress(json.dumps({"docs": docs, "sizes": sizes, "blocks": blocks, "ids": [a for a, _ in lengths], "lengths": [b for _, b in lengths]}).encode(), 6, mtime=0)
        out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
    return len(docs), total


class TokenFile:
    """A file opened for reads of single blocks."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC or self._read(0, 4) != MAGIC:
            raise ValueError("not a token file")
        n, = struct.unpack("<Q", tail[:8])
        foot = json.loads(gzip.decompress(self._read(size - 12 - n, n)))
        self.docs, self.sizes, self.blocks = foot["docs"], foot["sizes"], foot["blocks"]
        self.code = Code(dict(zip(foot["ids"], foot["lengths"], strict=True)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, marks, size = self.blocks[k]
        data = self._read(at, 4 * marks + size)
        return self.code.decode(data[4 * marks :], n, np.frombuffer(data[: 4 * marks], "<u4"))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents in order, a block at a time."""
        k, rest = 0, np.zeros(0, np.uint32)
        for doc, n in zip(self.docs, self.sizes, strict=True):
            parts = [rest]
            have = len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc, joined[:n]
            rest = joined[n:]


def write_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END, limit: int = MAX_BITS) -> DataFrame:
    """Writes token files to the shared folder and returns their list (path, part, documents, start), a written table.

    Files hold ascending ranges of ids, null ids first, and rows of one id, repeated rows too, one after the other in
    the order of their tokens.  ``start`` counts the ids of all files before.  An empty table has no files.  Texts are
    tokenized once; their ids are kept, sorted, in the shared folder until the counts are known.
    """
    spark = df.sparkSession
    tokens = written(tokenize(df, id_col, text_col, tokenizer, end), "token-ids")
    # Bounded by the vocabulary; plain numbers, since a broadcast object of a class is pickled by name.
    code = spark.sparkContext.broadcast(code_lengths(count_ids(tokens, f"<u{width(tokenizer)}"), limit))
    folder = shared_folder(spark, "tokens")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows of one id, if there are many, lie in several parts: the order goes on by a hash of the tokens.
    dealt = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id())
    files = written(dealt.select("part", "id", "ids").mapInArrow(_writer(folder, code, f"<u{width(tokenizer)}"), "part int, path string, documents long, tokens long"), "token-files")
    # A row for each file; every file's start is the sum of those before.
    totals = [(r["part"], r["tokens"]) for r in files.select("part", "tokens").collect()]
    starts, at = [], 0
    for part, size in sorted(totals):
        starts.append((part, at))
        at += size
    return files.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")


def _writer(folder: str, code: Broadcast, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [0]

        def rows():
            for b in bounded(batches, "ids"):
                part[0] = b.column(0)[0].as_py()
                yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        system, inner = storage(folder)
        table = Code(code.value)
        it = rows()
        for one in it:
            name = f"{os.urandom(12).hex()}.tids"
            docs, tokens = _write(system, f"{inner}/{name}", table, kind, (x for part in ([one], it) for x in part))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "path": [f"{folder}/{name}"], "documents": [docs], "tokens": [tokens]})

    return run


def read_tokens(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids): the documents of all files of a list (path, start); ids are packed."""
    n = max(1, min(files.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, inner = storage(path)
                with system.open_input_file(inner) as f:
                    held, size = [], 0
                    for doc, ids in TokenFile(f).documents():
                        held.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size >= 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    return files.select("path", "start").repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
        ["id", "start", "n_tokens", "ids"],
    )

