"""Quality by a convolutional network over bytes, in numpy.

Every byte has a learned vector; learned filters slide over them; each filter's greatest answer in a chunk of
``2 * HALF`` bytes is kept.  Chunks start every ``HALF`` bytes, so they overlap and cover the whole text.  The mean and
the maximum over all chunks pass one hidden layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, two
from .samples import held_out, labelled, sigmoid

SIZE, WIDTH, STRIDE, FILTERS, HIDDEN, HALF = 6, 8, 2, 24, 16, 256
PAD = 256
#: Bytes convolved at once; labelled texts of each class, whole; passes over them; cut of the score.
BLOCK, PER_CLASS, EPOCHS, CUT = 1 << 19, 1_500, 12, 0.3


@dataclass(frozen=True)
class Net:
    vectors: np.ndarray  # (257, SIZE); the last one, for padding, stays zero
    filters: np.ndarray  # (WIDTH * SIZE, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (2 * FILTERS + 1, HIDDEN); the last input is the text's length
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each filled up to whole halves with room for a filter; halves of each text)."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts], np.int64)
    data = np.full(int(halves.sum()) * HALF + WIDTH, PAD, np.int16)
    for t, at in zip(texts, (np.cumsum(halves) - halves) * HALF, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return data, halves


def _windows(net: Net, data: np.ndarray) -> np.ndarray:
    """The vectors under each place of the filters."""
    x = net.vectors[data].reshape(-1)
    n = (len(data) - WIDTH) // STRIDE
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * SIZE), (STRIDE * SIZE * step, step), writeable=False)


def pools(net: Net, data: np.ndarray) -> np.ndarray:
    """Each filter's greatest answer in each half, before the threshold."""
    out = []
    per = BLOCK // HALF * HALF
    for at in range(0, len(data) - WIDTH, per):
        z = _windows(net, data[at : at + per + WIDTH]) @ net.filters
        out.append(z.reshape(-1, HALF // STRIDE, FILTERS).max(1))
    return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half, first chunk of each text) of all chunks; a text of one half is one chunk."""
    n = np.maximum(halves - 1, 1)
    first = np.cumsum(n) - n
    start = np.repeat(np.cumsum(halves) - halves - first, n) + np.arange(int(n.sum()))
    return start, start + np.repeat(halves > 1, n), first


def _lengths(texts: list[bytes]) -> np.ndarray:
    return np.log1p(np.array([[len(t)] for t in texts], np.float32)) / 4 - 1.5


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    """A probability for each text."""
    if not texts:
        return np.zeros(0)
    data, halves = padded(texts)
    h = np.maximum(pools(net, data) + net.bias, 0)
    a, b, first = _chunks(halves)
    c = np.maximum(h[a], h[b])
    n = np.diff(np.append(first, len(c)))[:, None]
    f = np.concatenate([np.add.reduceat(c, first) / n, np.maximum.reduceat(c, first), _lengths(texts)], 1)
    return sigmoid((np.tanh(f @ net.hidden + net.hidden_bias) @ net.out + net.out_bias)[:, 0].astype(np.float64))


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    data, halves = padded(texts)
    win = _windows(net, data)
    z = (win @ net.filters).reshape(-1, HALF // STRIDE, FILTERS)
    best = z.argmax(1)  # (halves, FILTERS)
    top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + net.bias
    h = np.maximum(top, 0)
    a, b, first = _chunks(halves)
    c = np.maximum(h[a], h[b])
    sizes = np.diff(np.append(first, len(c)))
    mean, most = np.add.reduceat(c, first) / sizes[:, None], np.maximum.reduceat(c, first)
    f = np.concatenate([mean, most, _lengths(texts)], 1)
    t = np.tanh(f @ net.hidden + net.hidden_bias)
    d = (sigmoid((t @ net.out + net.out_bias)[:, 0]) - y)[:, None].astype(np.float32) / len(y)
    g_out, g_out_bias = t.T @ d, d.sum(0)
    d = d @ net.out.T * (1 - t * t)
    g_hidden, g_hidden_bias = f.T @ d, d.sum(0)
    d = d @ net.hidden.T
    own = np.repeat(np.arange(len(y)), sizes)
    dc = (d[:, :FILTERS] / sizes[:, None])[own]
    top_chunks = (c == most[own]).astype(c.dtype)  # chunks that tie share the gradient
    dc += d[own, FILTERS : 2 * FILTERS] * top_chunks / np.add.reduceat(top_chunks, first)[own]
    left = h[a] >= h[b]
    dh = np.zeros_like(h)
    np.add.at(dh, a, dc * left)
    np.add.at(dh, b, dc * ~left)
    dh *= top > 0
    rows = (np.arange(len(h))[:, None] * (HALF // STRIDE) + best).ravel()
    seen = win[rows].reshape(len(h), FILTERS, WIDTH * SIZE)
    g_filters = np.einsum("hf,hfk->kf", dh, seen, optimize=True)
    dx = (dh[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, SIZE)
    g_vectors = np.zeros_like(net.vectors)
    under = data[(rows * STRIDE)[:, None] + np.arange(WIDTH)]
    for k in range(SIZE):
        g_vectors[:, k] = np.bincount(under.ravel(), dx[:, :, k].ravel(), 257)
    g_vectors[PAD] = 0
    return [g_vectors, g_filters, dh.sum(0), g_hidden, g_hidden_bias, g_out, g_out_bias]


def fit(rows: list[tuple[str, int]], share: float | None = None, epochs: int = EPOCHS, batch: int = 32, rate: float = 4e-3) -> Net:
    """From (text, label) rows; the same rows give the same net.  ``share`` is label 1's share of the corpus: a sample
    with another one has its constant shifted.  No rows, or one class, give a constant score."""
    rng = np.random.default_rng(11)
    make = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    vectors = make(257, SIZE, s=0.5)
    vectors[PAD] = 0
    net = Net(vectors, make(WIDTH * SIZE, FILTERS, s=0.15), np.zeros(FILTERS, np.float32), make(2 * FILTERS + 1, HIDDEN, s=0.15), np.zeros(HIDDEN, np.float32), make(HIDDEN, 1, s=0.25), np.zeros(1, np.float32))
    y = np.array([v for _, v in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = 6.0 if len(rows) and y.max() == 1 else -6.0
        return net
    data = [t.encode() for t, _ in rows]
    m, v, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for e in range(epochs):
        order = rng.permutation(len(data))
        now = rate * (1 - e / epochs) + 2e-4
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            for p, g, a, b in zip(net.parts(), _gradients(net, [data[k] for k in pick], y[pick]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    if share is not None and 0 < share < 1:
        net.out_bias[:] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return net


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, rest: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id") -> Net:
    """A net from labelled documents whose crc32 does not leave ``rest``: at most ``per_class`` texts of each class and
    each of them whole, the same at every size of the tables."""
    keep = ~held_out(F.col(id_col), divisor, rest)
    share = labels.where(keep & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(labelled(documents, labels, label, keep, per_class, id_col), share)


def score(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score for each row: whole texts, one pass, no shuffle.  A null text is an empty one, which is scored
    too; repeated rows, null ids and ties are rows like any other; other columns are not carried."""
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(net, [t.encode() for t in b.column(1).to_pylist()]))], ["id", "score"])

    return two(df, id_col, text_col).mapInArrow(run, f"id {key.simpleString()}, score double").withColumnRenamed("id", id_col)
