"""Toxicity by compression distance.

Two zstandard dictionaries of raw content are trained, one on ordinary and one on toxic text.  A window of words is
compressed with the ordinary content alone and with the toxic content after it: where the second is shorter, the
window says what toxic texts say.  A text's largest savings, against thresholds calibrated on labelled texts that
neither dictionary has seen, give its probability.

The library's own trainer picks a dictionary of a few kilobytes from epochs of its samples and leaves out frequent
pieces of the toxic text (README has what was measured).  So the toxic content is chosen here by the same idea, a
cover of frequent pieces: spans of bytes whose 5-grams are far commoner in toxic than in ordinary text, the commonest
last, nearest to the window, until every such 5-gram is covered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, once
from .samples import held_out, labelled, logistic, sigmoid

WINDOW, GRAM = 10, 5
#: A 5-gram is toxic if this share of toxic texts has it, this many times the share of ordinary texts; bytes of a span.
SHARE, TIMES, LONGEST = 0.03, 15.0, 24
#: Bytes of the contents; labelled texts of each class, whole.
ORDINARY_BYTES, TOXIC_BYTES, PER_CLASS = 16_384, 4_096, 3_000
#: A window counts as a hit from this saving on; texts count as toxic from this score on.
SAVED, CUT = 2, 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    """All words of the text in lower case, ``WINDOW`` at a time; no words give no windows."""
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def _pieces(b: bytes) -> list[bytes]:
    """The 5-grams of some bytes, and their beginnings of 6 to 9 bytes if they begin a word: with letters of two bytes
    a 5-gram is short."""
    starts = [b[:n] for n in range(GRAM + 1, min(GRAM + 4, len(b)) + 1)] if b[:1] == b" " else []
    return [b[i : i + GRAM] for i in range(max(1, len(b) - GRAM + 1))] + starts


def _content(toxic: list[str], ordinary: list[str]) -> bytes:
    def shares(texts):
        words = Counter(w for t in texts for w in set(t.lower().split()))
        grams = Counter()
        for w, n in words.items():
            for g in set(_pieces(f" {w} ".encode())):
                grams[g] += n
        return words, grams

    (words, mine), (_, theirs) = shares(toxic), shares(ordinary)
    least = max(4, SHARE * len(toxic))
    good = {g for g, n in mine.items() if n >= least and n / len(toxic) >= TIMES * (theirs[g] + 1) / max(1, len(ordinary))}
    found: dict[bytes, list[tuple[bytes, int, int]]] = {}
    for w, n in words.items():
        b = f" {w} ".encode()
        begins = [k for k in range(GRAM, GRAM + 5) if k <= len(b) and b[:k] in good]
        at = [i for i in range(len(b) - GRAM + 1) if b[i : i + GRAM] in good]
        if begins:  # a telling beginning is enough: what follows it are endings
            found.setdefault(b[: begins[0]], []).append((b, 0, n))
        elif at:
            found.setdefault(b[at[0] : at[-1] + GRAM], []).append((b, at[0], n))
    spans = Counter()
    for s, seen in found.items():
        spans[_grown(s, seen)] += sum(n for *_, n in seen)
    parts: list[bytes] = []
    for s, n in sorted(spans.items(), key=lambda x: (-x[1], x[0])):
        if n >= least and not any(s in p for p in parts) and sum(map(len, parts)) + len(s) <= TOXIC_BYTES:
            parts.append(s)
    return b"".join(reversed(parts))


def _grown(span: bytes, seen: list[tuple[bytes, int, int]]) -> bytes:
    """The span with the bytes after it, as long as most of the words that have it go on alike: a toxic stem's later
    pieces are common ones, so only its first may be telling, but the whole is what saves bytes."""
    total = sum(n for *_, n in seen)
    while len(span) < LONGEST:
        following = Counter()
        for b, at, n in seen:
            if b[at : at + len(span)] == span and at + len(span) < len(b):
                following[b[at + len(span)]] += n
        c, n = max(following.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if 2 * n <= total:
            break
        span += bytes([c])
    return span


def _compressor(content: bytes) -> zs.ZstdCompressor:
    # The library does not index the last bytes of a content: they are filled, or the commonest span would be lost.
    d = zs.ZstdCompressionDict(content + b"\n" * 16, dict_type=zs.DICT_TYPE_RAWCONTENT)
    p = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17,
        hash_log=15, chain_log=15, search_log=3, min_match=5, target_length=16, strategy=zs.STRATEGY_DFAST,
    )
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Compressors of one model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress

    def savings(self, text: str) -> np.ndarray:
        a, b = self.a, self.b
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64)

    def features(self, text: str) -> list[float]:
        """The largest saving, the three largest, how many hits and what share of windows, and the text's length."""
        d = self.savings(text)
        if not len(d):
            return [0.0] * 6
        top = np.sort(d)[::-1][:3]
        hits = int((d >= SAVED).sum())
        return [float(top[0]), float(top.sum()), float(np.log1p(hits)), 10.0 * hits / len(d), float(np.log1p(len(d))), float(np.log1p((d >= SAVED + 2).sum()))]


def _scorer(ordinary: bytes, toxic: bytes) -> Scorer:
    return once(f"toxicity-{hashlib.sha256(ordinary + b'/' + toxic).hexdigest()}", lambda: Scorer(ordinary, toxic))


def _contents(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic content."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    said = [w for t in ordinary for w in windows(t)]
    try:
        base = zs.train_dictionary(ORDINARY_BYTES, said).as_bytes()
    except zs.ZstdError:  # too few samples to train on
        base = b"".join(said)[-ORDINARY_BYTES:]
    return base, _content(toxic, ordinary) if toxic else b""


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """From (text, label) rows; ``share`` is label 1's share of the corpus, that of the rows unless given.  Each half's texts are scored with contents from the other half, which calibrates on
    texts that the contents have not seen; the model's contents come from all.  Without both classes the score is near
    the share of toxic rows."""
    if not rows:
        return Model(b"", b"", (0.0,) * 6 + (-30.0,))
    halves = [rows[0::2], rows[1::2]]
    x, y = [], []
    for mine, other in (halves, halves[::-1]):
        s = Scorer(*_contents(other))
        x += [s.features(t) for t, _ in mine]
        y += [v for _, v in mine]
    x, y = np.array(x), np.array(y, float)
    base, more = _contents(rows)
    # Classes are sampled alike; weights undo that with the odds of all labels.
    share = y.mean() if share is None else share
    n = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(base, more, tuple(logistic(x, y, n).tolist()))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, rest: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id") -> Model:
    """A model from labelled documents whose crc32 does not leave ``rest``.  The sample is at most ``per_class`` texts
    of each class, whole; it is the same at every size of the tables.  The classes' odds are those of all labels that
    are not held out."""
    keep = ~held_out(F.col(id_col), divisor, rest)
    share = labels.where(keep & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(labelled(documents, labels, label, keep, per_class, id_col), share)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score for each row: whole texts, one pass, no shuffle.

    A null or empty text has no windows and scores as its features, all zero, say.  Repeated rows, null ids and ties
    are rows like any other.
    """
    return _scored(df, [id_col], model, text_col).select(F.col(f"kept.{id_col}").alias(id_col), "score")


def below(df: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is under ``cut``, with all their columns, whatever their names."""
    return _scored(df, df.columns, model, text_col).where(F.col("score") < cut).select("kept.*")


def _scored(df: DataFrame, keep: list[str], model: Model, text_col: str) -> DataFrame:
    """(kept, score): the columns of ``keep`` as a struct."""
    kept = F.struct(*[df[k] for k in keep]).alias("kept")
    rows = df.select(kept, F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = _scorer(model.ordinary, model.toxic), np.array(model.weights)
        for b in bounded(batches, "text"):
            x = np.array([s.features(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(x @ w[:-1] + w[-1]))], ["kept", "score"])

    return rows.mapInArrow(run, f"kept {kind}, score double")
