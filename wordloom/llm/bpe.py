"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one encoding, so one last token.  It is the one token that ends the prefix and may follow
the last token of the prefix before it: ``t`` may follow ``s`` if no merge across their border would have come before
the merges that made them.  Storing the last token of every prefix makes appends exact without a second look at what
was there, and lets an edit stop as soon as the stored tokens agree again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, flat_ranges, once, two
from .tokens import TOKEN_BATCH, Words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pairs of tokens, pieces and words whose answers a worker keeps.
KEEP_PAIRS, KEEP_PIECES, KEEP_WORDS = 300_000, 50_000, 400_000


class Vocabulary:
    """Ranks of tokens, how each was merged, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pieces_of = ranks, regex.compile(pattern).findall
        self.table = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.endings: dict = {}  # a trie of reversed tokens; a token's rank is at None
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                for cut in range(len(token) - 1, 0, -1):
                    a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                    if a is not None and b is not None and a < rank and b < rank and self._follows(a, b):
                        self.parts[rank] = (a, b)
                        self.merged[a, b] = rank
                        break
                else:
                    continue  # no merge makes it: only a whole piece can be this token
            node = self.endings
            for c in reversed(token):
                node = node.setdefault(c, {})
            node[None] = rank
        self.known: dict[int, bool] = {}
        self.kept: dict[str, list[int]] = {}

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a rank file; once per path and process."""

        def read() -> Vocabulary:
            with open(path, "rb") as f:
                return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

        return once(f"bpe-vocabulary-{path}", read)

    def _follows(self, a: int, b: int) -> bool:
        """Undo the merges beside the border, latest first; a pair that would have merged before one of them is none."""
        before = float("inf")
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < before:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                before, a = a, pa_[1]
            else:
                before, b = b + 0.5, pb[0]  # of merges of one rank the left one comes first

    def follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        v = self.known.get(key)
        if v is None:
            if len(self.known) >= KEEP_PAIRS:
                self.known.clear()
            v = self.known[key] = self._follows(a, b)
        return v

    def extend(self, data: bytes, last: list[int], sizes: list[int], to: int) -> None:
        """Adds the last token, and its bytes, of each prefix of up to ``to`` bytes; those of shorter ones stay."""
        endings, known = self.endings, self.known
        for i in range(len(last), to + 1):
            node = endings
            j = i
            while j:
                j -= 1
                node = node.get(data[j])
                if node is None:
                    raise ValueError("a byte has no token")
                if None in node:
                    t = node[None]
                    if not j:
                        break
                    ok = known.get(last[j] << 32 | t)
                    if ok or (ok is None and self.follows(last[j], t)):
                        break
            last.append(t)
            sizes.append(i - j)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()

    def encode_text(self, text: str) -> list[int]:
        """Every match of the pattern by itself, one after the other."""
        out, kept = [], self.kept
        for p in self.pieces_of(text):
            v = kept.get(p)
            if v is None:
                v = self.encode_piece(p.encode())
                if len(p) <= 64:
                    if len(kept) >= KEEP_PIECES:
                        kept.clear()
                    kept[p] = v
            out += v
        return out

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_text(t) for t in texts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def re_encode(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with ``[start, end)`` replaced, and its ids; only what lies between the nearest sure borders on
        both sides of the edit is encoded.  A single space between two characters that are no white space is a border
        whatever stands beyond them."""
        sure = regex.compile(r"(?<=\S) (?=\S)")
        m = sure.search(text[:start][::-1])
        left = start - 1 - m.start() if m else 0
        m = sure.search(text, end)
        while m and m.start() <= end:  # the character before it must be outside the edit
            m = sure.search(text, m.start() + 1)
        right = len(text) if m is None else m.start()
        at, k, n = 0, 0, len(text[:left].encode())
        while at < n:
            at += len(self.table[ids[k]])
            k += 1
        at, tail, n = 0, len(ids), len(text[right:].encode())
        while at < n:
            tail -= 1
            at += len(self.table[ids[tail]])
        return text[:start] + new + text[end:], ids[:k] + self.encode_text(text[left:start] + new + text[end:right]) + ids[tail:]


class Prefixes:
    """The last token of every prefix of a growing, editable piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.sizes = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is stored stays as it is."""
        self.data += more
        self.v.extend(self.data, self.last, self.sizes, len(self.data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces ``[start, end)``; returns how many prefixes were computed.  Once as many stored tokens in a row
        agree as the longest token has bytes, the rest is as it was."""
        old, shift, n = self.last[end:], len(new) - (end - start), self.v.longest
        rest, rest_sizes = old, self.sizes[end:]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :], self.sizes[start + 1 :]
        agree = done = 0
        for i in range(start + 1, len(self.data) + 1):
            self.v.extend(self.data, self.last, self.sizes, i)
            done += 1
            k = i - shift - end
            agree = agree + 1 if k > 0 and rest[k] == self.last[i] else 0
            if agree >= n:
                self.last += rest[k + 1 :]
                self.sizes += rest_sizes[k + 1 :]
                break
        return done

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes (all): a walk back over last tokens."""
        out, i = [], len(self.data) if length is None else length
        while i:
            out.append(self.last[i])
            i -= self.sizes[i]
        return out[::-1]


class Table:
    """The bytes of all tokens end to end, to decode many values at once."""

    def __init__(self, table: dict[int, bytes]):
        n = max(table, default=-1) + 1
        sizes = np.zeros(n, np.int64)
        sizes[list(table)] = [len(t) for t in table.values()]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(table[k] for k in sorted(table)), np.uint8)

    @staticmethod
    def load(path: str) -> Table:
        def read() -> Table:
            with open(path, "rb") as f:
                return Table({int(b): base64.b64decode(a) for a, b in map(bytes.split, f)})

        return once(f"bpe-table-{path}", read)

    def decode(self, column: pa.Array) -> pa.Array:
        """Bytes for each packed value; null for null."""
        counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        ids = np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), "<u4")
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        sizes = self.sizes[ids]
        data = self.bytes[flat_ranges(self.starts[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pc.if_else(pc.is_null(column), pa.scalar(None, pa.binary()), out) if column.null_count else out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, arrays: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids: one row for each row.  ``ids`` are an array, or else, which :func:`decode` takes,
    little-endian unsigned 32-bit integers in a binary value.

    A null text is empty; an empty text has no ids; long texts are whole; repeated rows and null ids are rows like any
    other; other columns are not carried.  Work is a pass over the rows: no shuffle, caches of bounded size.
    """
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary)
        words = _WORDS.setdefault(vocabulary, Words(v.encode_many, KEEP_WORDS))
        for b in bounded(batches, "text", TOKEN_BATCH // 2):
            ids, counts = words.encode_texts(b.column(1))
            if arrays:
                coded = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int32)))
            else:
                coded = packed(ids, counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), coded], ["id", "n_tokens", "ids"])

    kind = "array<int>" if arrays else "binary"
    return two(df, id_col, text_col).mapInArrow(run, f"id {key.simpleString()}, n_tokens long, ids {kind}").withColumnRenamed("id", id_col)


_WORDS: dict[str, Words] = {}


def packed(ids: np.ndarray, counts: np.ndarray, kind: str = "<u4") -> pa.Array:
    """A binary value of little-endian unsigned integers for each count."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind).tobytes())])


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col``, ids, decoded (binary).  Null ids decode to null, no ids to no bytes; an id that the vocabulary does
    not have fails the job."""
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.load(vocabulary)
        for b in bounded(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), table.decode(b.column(1))], ["id", "ids", "decoded"])

    rows = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"id {key.simpleString()}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def replace(df: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Edits of encoded texts: from ``id_col``, text, ids, start, end, new to ``id_col``, text, ids after the edit.

    Only the surroundings of the edit are encoded again.  An append is an edit at the end.  Nulls: a null text or null
    ids count as empty, a null ``new`` deletes, a null start is 0, a null end is the start; places beyond the text are
    its end.
    """
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.load(vocabulary)
        for b in bounded(batches, "text"):
            texts, ids = [], []
            for r in b.to_pylist():
                text = r["text"]
                start = min(max(r["start"] or 0, 0), len(text))
                end = min(max(start if r["end"] is None else r["end"], start), len(text))
                t, i = v.re_encode(text, np.frombuffer(r["ids"], "<u4").tolist(), start, end, r["new"] or "")
                texts.append(t)
                ids.append(np.array(i, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.binary())], ["id", "text", "ids"])

    rows = df.select(df[id_col].alias("id"), F.coalesce(df["text"], F.lit("")).alias("text"), F.coalesce(df["ids"], F.lit(b"")).alias("ids"), df["start"].cast("int").alias("start"), df["end"].cast("int").alias("end"), df["new"].cast("string").alias("new"))
    return rows.mapInArrow(run, f"id {key.simpleString()}, text string, ids binary").withColumnRenamed("id", id_col)
