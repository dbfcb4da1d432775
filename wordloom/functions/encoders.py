"""Text encoders: a pluggable batch interface and a deterministic default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from . import arrow as A

BATCH = 128  # texts per encoder call
Encoder = Callable[[list[str]], np.ndarray]


def ngram_encoder(dim: int = 64, n: int = 3, salt: str = "") -> Encoder:
    """Signed hashing of character n-grams: no model needed, the same vector on every machine.

    Each n-gram of the text padded with one blank on both sides adds +1 or -1 to one entry, by the md5 of
    ``salt`` and the n-gram.  A text that cancels to zero gets the first unit vector.
    """

    @lru_cache(maxsize=1 << 18)
    def place(gram: str) -> tuple[int, float]:
        h = hashlib.md5((salt + gram).encode()).hexdigest()
        return int(h[:8], 16) % dim, 1.0 if int(h[8], 16) < 8 else -1.0

    def encode(texts: list[str]) -> np.ndarray:
        padded = [f" {t} " for t in texts]
        sizes = np.fromiter(map(len, padded), np.int64, len(padded))
        joined = "".join(padded)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) < n:
            points = np.zeros(0, np.uint32)
        # each n-gram becomes a number; every distinct one is hashed once for the whole batch
        code = points[: len(points) - n + 1].astype(np.int64) if len(points) else np.zeros(0, np.int64)
        for k in range(1, n):
            code = np.unique(code * 0x110000 + points[k : len(points) - n + 1 + k], return_inverse=True)[1]
        row = np.repeat(np.arange(len(texts)), sizes)[: len(code)]
        inside = row == np.repeat(np.arange(len(texts)), sizes)[n - 1 : n - 1 + len(code)]
        code, row, at = code[inside], row[inside], np.flatnonzero(inside)
        kinds, first, which = np.unique(code, return_index=True, return_inverse=True)
        places = [place(joined[i : i + n]) for i in at[first].tolist()]
        spot = np.array([p for p, _ in places], np.int64)[which] if len(kinds) else which
        sign = np.array([s for _, s in places])[which] if len(kinds) else np.zeros(0)
        out = np.bincount(row * dim + spot, sign, len(texts) * dim).reshape(len(texts), dim).astype(float)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        flat = length[:, 0] == 0
        out /= np.where(length > 0, length, 1.0)
        out[flat, 0] = 1.0
        return out

    return encode


# Encoder factories by name: each is called once per Python worker, so a model is loaded once per worker.
REGISTRY: dict[str, Callable[[], Encoder]] = {
    "visual": lambda: ngram_encoder(64, 3, "v:"),
    "semantic": lambda: ngram_encoder(96, 4, "s:"),
}


def register(name: str, factory: Callable[[], Encoder]) -> None:
    REGISTRY[name] = factory


def embed_text(
    df: DataFrame,
    text: str,
    spaces: dict[str, str | Callable[[], Encoder]],
    batch: int = BATCH,
) -> DataFrame:
    """Add one unit vector column per space.  ``spaces`` maps a column to an encoder name or factory.

    All spaces are filled in one pass; a NULL text gives NULL vectors.
    """
    makers = {c: REGISTRY[e] if isinstance(e, str) else e for c, e in spaces.items()}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    schema = ", ".join([*fields, *[f"`{c}` array<double>" for c in makers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {c: make() for c, make in makers.items()}
        for b in batches:
            texts = b.column(b.schema.names.index(text)).to_pylist()
            gone = np.array([t is None for t in texts])
            cols = list(b.columns)
            for enc in encoders.values():
                full = [t or "" for t in texts]
                parts = [enc(full[i : i + batch]) for i in range(0, len(full), batch)]
                if not parts:
                    cols.append(pa.array([], pa.list_(pa.float64())))
                    continue
                mat = np.concatenate(parts)
                norms = np.linalg.norm(mat, axis=1, keepdims=True)
                lists = A.lists(mat / np.where(norms > 0, norms, 1.0))
                cols.append(lists if not gone.any() else pa.array([None if g else x for g, x in zip(gone, lists.to_pylist())], lists.type))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *encoders])

    return spread(df).mapInArrow(run, schema)


def embed_models(df: DataFrame, text: str, models: list[str]) -> DataFrame:
    """Long form: one row per (row, model) with ``model`` and ``vector``."""
    from pyspark.sql import functions as F

    wide = embed_text(df, text, {f"_m{i}": m for i, m in enumerate(models)})
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_m{i}").alias("vector")) for i, m in enumerate(models)]))
    return wide.select(*df.columns, each.alias("e")).select(*df.columns, "e.model", "e.vector")


def pool_tokens(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Masked mean of token vectors, scaled to unit length; zero where the mask leaves nothing.

    ``tokens`` has ``by``, ``mask`` (0/1) and ``vector``.  The scaling makes the division by the number of
    tokens immaterial, so this is the unit vector of the masked sum, added up map-side.
    """
    from pyspark.sql import functions as F

    from ..operators.moments import centroids

    masked = tokens.select(
        *by,
        F.lit(0).cast("bigint").alias("ordinal"),
        F.transform("vector", lambda x: x.cast("double") * F.col("mask")).alias("visual"),
        F.lit(None).cast("array<double>").alias("semantic"),
    )
    return centroids(masked, by).select(*by, F.col("visual").alias("vector"))
