"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A signature has ``VALUES`` least hashes.  A tree is one order of these values: all documents are sorted by their values
in that order, and those with the longest common prefix stand beside one another.  The sort is by range over (tree,
prefix, id), so a region as large as a third of all documents is dealt over many tasks.

Depth is adaptive.  A tree starts with ``STEP`` values; where more documents of several components agree in all of
them than a neighbour search looks at, that region alone is sorted anew by the next values, and so on down to the
whole signature.  Sparse regions stay shallow; ``DEPTH`` is the least agreement that counts.

The first round takes a few trees and next neighbours only; the links it confirms make components.  The second takes
all trees and more neighbours, but only pairs of different components.  So what is compared grows with the documents,
not with the square of a group.  A one-bit sketch of the signature drops unlikely pairs before their texts are fetched.

What neighbours of a bounded number leave is found exactly: a prefix filter over one order of all shingles, common
words last.  Two sets that are similar enough share one of their first ``n - least + 1`` shingles, for the smaller set
even one of a shorter prefix, and their sizes lie in the same or the next class; so every pair of different components
that shares such a shingle in such classes, and whose sizes, places in the order and parities allow the similarity, is
confirmed on full sets.  These are bounds, not estimates; no count of partners is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, once, two, written

VALUES, STEP, DEPTH = 128, 8, 4
#: (trees, neighbours on each side) of the two rounds.
ROUNDS = ((8, 1), (16, 8))
#: A region is crowded where more neighbours than this agree in all values of a step.
CROWD = 8
#: Sketch bits that may differ: at a similarity of 0.8 a tenth of 128 does, 0.22 is 4.5 deviations above.
DIFFER = 28
#: Bits of the map of candidates: 2**17 rows of 64 at most, whatever the corpus.
MAP_BITS = 23
#: Slots of word hashes whose counts order the shingles.  They set an order, no more.
SLOTS = 1 << 20
#: Bytes of a word that are hashed eight at a time with all others; a longer word is hashed alone.
LONG = 128
#: A size class spans this factor of set sizes at a threshold of 0.8: two steps of 1 / 0.8.
CLASS_STEPS = 2
#: Least set size of a class whose sets are found by parts of several shingles: the folded parities bound smaller ones.
LARGE = 1024
#: Prefix shingles that a task counts at once, and those of one part; rows of one side of a cell of a common shingle.
FLUSH, PART, CELL = 1 << 18, 1 << 18, 1 << 14
#: Bytes of prefixes that a task takes apart at once: each shingle becomes up to two rows of some 130 bytes.
TAKEN = 1 << 18
#: Rows times rows of a cell that are compared at once.
MET = 1 << 19
#: The same of a cell that is compared at once, whatever its components.
SMALL = 1 << 12
#: Pairs that a task holds before it hands them on; bytes of texts confirmed at once.
HELD, CONFIRM = 1 << 20, 2 << 20
#: Least bits of a set's parities: each shingle flips one, so sets differ by at least as many shingles as bits.
PARITY_BITS = 1024
#: The same folded, for rows that meet at a shingle: a pair's parities are compared there before it is made.
FOLDED = 512
#: Bits of the map of shared shingles.
SHARED_BITS = 24


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    def make():
        rng = np.random.default_rng(5)
        draw = lambda: rng.integers(1, 2**32, VALUES, dtype=np.uint32)
        return draw() | np.uint32(1), draw()

    return once("forest-hashes", make)


def _order(tree: int) -> np.ndarray:
    return once(f"forest-order-{tree}", lambda: np.random.default_rng(1000 + tree).permutation(VALUES))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, in which text it stands), in order; words are told apart by byte, all texts at once."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    # After all texts stand as many spaces as a long word is read beyond its end.
    text = np.full(len(raw) + LONG, 32, np.uint8)
    text[: len(raw)] = _lower()[raw]
    full = text[: len(raw)] != 32
    begins, stops = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    stops[:-1] &= ~full[1:]
    ends = ends - ends[0]
    first = ends[:-1][ends[:-1] < len(raw)]
    begins[first] = full[first]
    before = first[first > 0] - 1
    stops[before] = full[before]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(stops) + 1 - start
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    h, some = size.astype(np.uint64), slice(None)
    for at in range(0, LONG, 8):
        left = np.minimum(size[some] - at, 8)
        h[some] = _mix(h[some] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[some] + at] & _low()[left]))
        some = np.flatnonzero(size > at + 8)
        if not len(some):
            break
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]].tobytes())
    return h, np.searchsorted(ends[1:], start, "right")


def _lower() -> np.ndarray:
    """Each byte's lower-case form; white space is a space."""

    def make():
        to = np.arange(256, dtype=np.uint8)
        to[65:91] += 32
        to[9:14] = 32
        return to

    return once("forest-lower", make)


def _low() -> np.ndarray:
    """The masks of the first 0 to 8 bytes of eight."""
    return once("forest-low", lambda: np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles of ``k`` words as 64-bit hashes; fewer words are one shingle, none none."""
    return [s for s, _ in ordered(texts, k, None)]


def ordered(texts: pa.Array, k: int, levels: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's set and how common its shingles are: the sum of their words' levels, 0 without a table."""
    h, doc = _words(texts)
    ends = np.searchsorted(doc, np.arange(len(texts)), "right")
    starts = np.searchsorted(doc, np.arange(len(texts)), "left")
    prime = np.uint64(0x9E3779B97F4A7C15)
    level = np.zeros(len(h), np.int32) if levels is None else levels[(h & np.uint64(len(levels) - 1)).view(np.int64)].astype(np.int32)
    rolled, common = h, level
    for j in range(1, k):
        rolled = rolled[:-1] * prime + h[j:] if len(rolled) > 1 else rolled[:0]
        common = common[:-1] + level[j:] if len(common) > 1 else common[:0]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= k:
            s, at = np.unique(rolled[a : b - k + 1], return_index=True)
            out.append((s, common[a : b - k + 1][at]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = one * prime + h[i : i + 1]
            out.append((_mix(one), level[a:b].sum(keepdims=True)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, a stretch of the set at a time."""
    a, b = _hashes()
    least, half = np.full(VALUES, 2**32 - 1, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 1024):
        np.minimum(least, (half[at : at + 1024, None] * a + b).min(0), out=least)
    return least


def parity(s: np.ndarray) -> bytes:
    """Of each slot, whether an odd number of the set's shingles fall in it: four slots a shingle or more."""
    n = PARITY_BITS
    while n < 4 * len(s):
        n *= 2
    slots = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((slots & 1).astype(bool), bitorder="little").tobytes()


def fold(parity: bytes, size: int) -> np.ndarray:
    """A parity of ``size`` bits from a longer one: slots whose numbers differ by a multiple of it are one."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, size // 64), axis=0)


def _levels(df: DataFrame, id_col: str, text_col: str) -> bytes:
    """The level of each of ``SLOTS`` slots of word hashes: the logarithm of how often its words occur in all texts, in
    eighths of a bit, as 16-bit integers.

    Any order of shingles gives the same links; one that puts common words last gives few candidates.  A task counts
    all its texts before it hands its slots on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        with np.errstate(over="ignore"):
            for b in bounded(batches, "text"):
                h, _ = _words(b.column(0))
                n += np.bincount((h & np.uint64(SLOTS - 1)).view(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(n)
        for at in range(0, len(slot), 1 << 16):
            i = slot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(n[i])], ["slot", "n"])

    texts = two(df, id_col, text_col).where("id IS NOT NULL").select("text")
    top = texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    levels = np.zeros(SLOTS, np.int16)
    levels[top.column(0).to_numpy()] = 8 * np.log2(top.column(1).to_numpy())
    return levels.tobytes()


def _least(n: np.ndarray, share: int, of: int) -> np.ndarray:
    """The least integers that are ``share / of`` of ``n``."""
    return -(-n * share // of)


def signatures(df: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, key, sig, prefix, parity): ``key`` is equal for equal sets; ``prefix`` has the shingles that the
    exact round looks at, in the order of all shingles.  The last four are null for texts without words."""
    key = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(_levels(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in bounded(batches, "text"):
                both = ordered(b.column(1), k, np.frombuffer(held.value, np.int16))
                sets = [s for s, _ in both]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([_prefix(s, c, percent) if len(s) else None for s, c in both], pa.binary()),
                        pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "n_shingles", "key", "sig", "prefix", "parity"],
                )

    return two(df, id_col, text_col).mapInArrow(run, f"id {key}, n_shingles long, key binary, sig binary, prefix binary, parity binary")


def _grow(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, region, prefix, node, component, sketch): each class once in each tree, by its first values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                n = b.num_rows
                sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(n, VALUES)
                sketch = pa.array([x.tobytes() for x in np.packbits((sig & 1).astype(bool), axis=1)], pa.binary())
                short = (sig >> 3).astype(">u2")
                for t in range(trees):
                    prefix = pa.array([x.tobytes() for x in np.ascontiguousarray(short[:, _order(t)[:STEP]])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.zeros(n, np.int64)), prefix, b.column(0), b.column(1), sketch], ["tree", "region", "prefix", "node", "component", "sketch"])

    return classes.select("node", "component", "sig").mapInArrow(run, "tree int, region long, prefix binary, node long, component long, sketch binary")


def _deeper(crowded: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """The rows of crowded regions by their next values; a region is all values so far, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u4").reshape(b.num_rows, VALUES)
            sketch = pa.array([x.tobytes() for x in np.packbits((sig & 1).astype(bool), axis=1)], pa.binary())
            short = (sig >> 3).astype(">u2")
            rows = range(b.num_rows)
            next_values = pa.array([short[r, _order(int(tree[r]))[level * STEP : (level + 1) * STEP]].tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), next_values, b.column(2), b.column(3), sketch], ["tree", "region", "prefix", "node", "component", "sketch"])

    rows = crowded.join(classes.select("node", "component", "sig"), "node").select("tree", "region", "node", "component", "sig")
    return rows.mapInArrow(run, "tree int, region long, prefix binary, node long, component long, sketch binary")


def _neighbours(rows: DataFrame, near: int, level: int) -> DataFrame:
    """(a, b, tree, region): pairs a < b of neighbours of different components within a region that agree to ``DEPTH``
    values or more, with a tree of -1; and rows (a, -1, tree, region) of crowded regions, which hold more than ``CROWD``
    neighbours that agree in all values, of several components.

    Rows that stand at the border of two tasks meet in other trees, whose borders lie elsewhere.
    """
    least = DEPTH if level == 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            now = {
                "tree": b.column(0).to_numpy(zero_copy_only=False),
                "region": b.column(1).to_numpy(zero_copy_only=False),
                "prefix": np.frombuffer(b"".join(b.column(2).to_pylist()), ">u2").reshape(-1, STEP),
                "node": b.column(3).to_numpy(zero_copy_only=False),
                "component": b.column(4).to_numpy(zero_copy_only=False),
                "sketch": np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, VALUES // 64),
            }
            if tail is not None:
                now = {c: np.concatenate([tail[c], v]) for c, v in now.items()}
            old = 0 if tail is None else len(tail["node"])
            n = len(now["node"])
            found, mixed = [], np.zeros(n, bool)
            for s in range(1, CROWD + 1):
                i = np.arange(max(s, old), n)
                j = i - s
                one = (now["tree"][i] == now["tree"][j]) & (now["region"][i] == now["region"][j])
                ok = one & (now["component"][i] != now["component"][j])
                if s == CROWD:
                    full = one & (now["prefix"][i] == now["prefix"][j]).all(1)
                mixed[i[ok]] = True
                if s > near:
                    continue
                ok &= (now["prefix"][i, :least] == now["prefix"][j, :least]).all(1)
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(now["sketch"][i] ^ now["sketch"][j]).sum(1) <= DIFFER
                found.append(np.stack([now["node"][i[ok]], now["node"][j[ok]]]))
            pairs = np.sort(np.concatenate(found, 1), 0)
            ends = np.arange(max(CROWD, old), n)[full]
            ends = ends[mixed[ends]]
            dense = np.unique((ends[:, None] - np.arange(CROWD + 1)).ravel())
            prefix = now["prefix"][dense]
            region = now["region"][dense].view(np.uint64)
            for c in range(STEP):
                region = _mix(region * np.uint64(0x9E3779B97F4A7C15) + prefix[:, c].astype(np.uint64) + np.uint64(1))
            none = np.full(pairs.shape[1], -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(pairs[0], now["node"][dense])),
                    pa.array(np.append(pairs[1], np.full(len(dense), -1))),
                    pa.array(np.append(none, now["tree"][dense]).astype(np.int32)),
                    pa.array(np.append(none, region.view(np.int64))),
                ],
                ["a", "b", "tree", "region"],
            )
            tail = {c: v[-CROWD:] for c, v in now.items()}

    def quiet(batches):
        with np.errstate(over="ignore"):
            yield from run(batches)

    return rows.mapInArrow(quiet, "a long, b long, tree int, region long").distinct()


def _candidates(nodes: DataFrame, trees: int, near: int, n: int) -> DataFrame:
    """(a, b): the neighbours of all trees, crowded regions as deep as they need."""
    rows, pairs = _grow(nodes, trees), None
    for level in range(VALUES // STEP):
        dealt = rows.repartitionByRange(n, "tree", "region", "prefix", "node").sortWithinPartitions("tree", "region", "prefix", "node")
        found = written(_neighbours(dealt, near, level), "neighbours")
        mine = found.where("tree < 0").select("a", "b")
        pairs = mine if pairs is None else pairs.union(mine)
        crowded = found.where("tree >= 0").select("tree", "region", F.col("a").alias("node"))
        if not crowded.limit(1).count():
            break
        rows = _deeper(crowded, nodes, level + 1) if level + 1 < VALUES // STEP else rows
    return pairs.distinct()


def _prefix(s: np.ndarray, level: np.ndarray, percent: int) -> bytes:
    """What a set is found by, in the order of all sets: its rarest shingles, or the parts of :func:`_parts` in its own
    class of sizes if that is large, then those in the next class if it may be looked up there and that is large."""
    n = len(s)
    own, beyond = (int(_class(np.int64(x), percent)) for x in (n, n * 100 // percent))
    first = _parts(s, level, own, percent) if _large(own, percent) else s[np.lexsort((s, level))[: n - _least(n, percent, 100) + 1]]
    return first.tobytes() + (_parts(s, level, beyond, percent).tobytes() if beyond > own and _large(beyond, percent) else b"")


def _parts(s: np.ndarray, level: np.ndarray, c: int, percent: int) -> np.ndarray:
    """The parts of a set that show it in a class of large sizes, as hashes, those of many and rare shingles first.

    The hashes of all shingles are divided into parts, as many for each set of the class; two sets that differ in ``d``
    shingles agree in all parts but ``d``, so among the first ``d + 1`` of each, in one order of all parts and contents,
    there is one of both.  A part has two shingles or so: texts that have little but frequent shingles in common seldom
    agree in one.
    """
    parts = int(_bounds_of(percent)[2 * c + 1]) * 3 // 8
    part = (s % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    of = part[order]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    held, rare = np.add.reduceat(_mix(s[order]), at), np.add.reduceat((1 << 10) - level[order].astype(np.int64), at)
    of, most = of[at], _differ(len(s), True, percent) + 1
    if len(of) < most:  # empty parts are equal too
        none = np.setdiff1d(np.arange(parts), of)
        of, held, rare = np.append(of, none), np.append(held, np.zeros(len(none), np.uint64)), np.append(rare, np.zeros(len(none), np.int64))
    key = _mix(held + _mix(of.astype(np.uint64)))
    return key[np.lexsort((key, -rare))[:most]]


def _differ(n: np.ndarray, smaller: bool, percent: int) -> np.ndarray:
    """The most shingles in which a set of ``n`` differs from a similar one, if it is the smaller or the larger one."""
    return (n + (n * 100 // percent if smaller else n)) * (100 - percent) // (100 + percent)


def _flat(b: pa.RecordBatch, percent: int) -> tuple[np.ndarray, ...]:
    """(token, row of ``b``, place, whether it is looked up by larger sets, whether it looks up smaller ones) of the
    prefixes of (node, component, n, prefix) rows; a token is a shingle, or a part, in a class of sizes.

    Of a pair, the smaller set of n shingles shares at least ``2 * percent / (100 + percent)`` of them, so a shorter
    prefix of it is enough; the larger one's size is in the smaller one's class or, near its upper end, in the next.
    Parts have a place of 0, which bounds nothing.
    """
    blobs = b.column(3).to_pylist()
    n, size = b.column(2).to_numpy(zero_copy_only=False), np.array([len(p) // 8 for p in blobs], np.int64)
    row = np.repeat(np.arange(b.num_rows), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    held = np.frombuffer(b"".join(blobs), np.uint64)
    own, beyond = _class(n, percent), _class(n * 100 // percent, percent)
    in_parts, next_parts = _large(own, percent), _large(beyond, percent)
    first = np.where(in_parts, _differ(n, True, percent) + 1, n - _least(n, percent, 100) + 1)
    mine = (place < first[row]) | ~((beyond > own) & next_parts)[row]
    short = mine & np.where(in_parts[row], True, place <= (n - _least(n, 2 * percent, 100 + percent))[row])
    probes = mine & np.where(in_parts[row], place <= _differ(n, False, percent)[row], True)
    more = np.flatnonzero((beyond > own)[row] & np.where(next_parts[row], ~mine, short))
    kept = np.flatnonzero(mine)
    token = np.concatenate([_mix(held[kept] + _mix(own.astype(np.uint64))[row[kept]]), _mix(held[more] + _mix(beyond.astype(np.uint64))[row[more]])])
    at = np.append(np.where(in_parts[row[kept]], 0, place[kept]), np.where(next_parts[row[more]], 0, place[more]))
    none = np.zeros(len(more), bool)
    return token.view(np.int64), np.append(row[kept], row[more]), at, np.append(short[kept], ~none), np.append(probes[kept], none)


def _large(c: np.ndarray, percent: int) -> np.ndarray:
    """Whether all sizes of a class are ``LARGE`` or more, so that its sets are found by parts."""
    return _bounds_of(percent)[np.maximum(2 * np.asarray(c) - 1, 0)] >= LARGE


def _class(n: np.ndarray, percent: int) -> np.ndarray:
    """The class of a set size: integer bounds, each at least 100 / percent times the one before, ``CLASS_STEPS`` a class."""
    return np.searchsorted(_bounds_of(percent), n, "right") // CLASS_STEPS


def _bounds_of(percent: int) -> np.ndarray:
    return once(f"forest-classes-{percent}", lambda: _bounds(percent))


def _bounds(percent: int) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def _counted(token, low, high, index, total) -> tuple[np.ndarray, ...]:
    """The same columns with one row for each token: least and greatest component, rows of the short and long prefix."""
    order = np.argsort(token)
    token = token[order]
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    if not len(at):
        return token, low, high, index, total
    return token[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(index[order], at), np.add.reduceat(total[order], at)


def _tallied(batches: Iterator[pa.RecordBatch], percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, blob): the counted tokens of ``FLUSH`` prefix shingles at a time, a row for each part that has some."""
    held, rows = [], 0

    def flush():
        c = _counted(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        part = (c[0].view(np.uint64) >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            i = order[ends[p] : ends[p + 1]]
            blob = b"".join((c[0][i].tobytes(), c[1][i].tobytes(), (c[2][i] - c[1][i]).tobytes(), c[3][i].tobytes(), c[4][i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    for b in bounded(batches, "prefix", TAKEN):
        with np.errstate(over="ignore"):
            token, row, _, short, probes = _flat(b, percent)
        component = b.column(1).to_numpy(zero_copy_only=False)[row]
        held.append((token, component, component, short.astype(np.int64), probes.astype(np.int64)))
        rows += len(row)
        if rows >= FLUSH:
            yield from flush()
            rows = 0
    if held:
        yield from flush()


def _shared(prefixes: DataFrame, percent: int, parts: int, n: int) -> DataFrame:
    """(token, ni, np): the tokens of several components, with rows that are looked up and rows that look up.

    Tasks count their own shingles first, so a common one is one entry of each task.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blobs):
            cols = [np.frombuffer(x, np.int64).reshape(5, -1) for x in blobs]
            token, low, gap, index, total = np.concatenate(cols, 1)
            token, low, high, index, total = _counted(token, low, low + gap, index, total)
            ok = (low < high) & (index > 0) & (total > 0)
            return pa.RecordBatch.from_arrays([pa.array(token[ok]), pa.array(index[ok]), pa.array(total[ok])], ["token", "ni", "np"])

        now, blobs = None, []
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if blobs and p != now:
                    yield out(blobs)
                    blobs = []
                now = p
                blobs.append(blob)
        if blobs:
            yield out(blobs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tallied(batches, percent, parts)

    rows = prefixes.select("node", "component", "n_shingles", "prefix")
    blobs = rows.mapInArrow(count, "part int, blob binary").repartition(n, "part").sortWithinPartitions("part")
    return blobs.mapInArrow(meet, "token long, ni long, np long")


def _spread(batches: Iterator[pa.RecordBatch], percent: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each prefix shingle that the map of shared ones holds, ``TAKEN`` bytes of prefixes at a time."""
    for b in bounded(batches, "prefix", TAKEN):
        with np.errstate(over="ignore"):
            token, row, at, short, probes = _flat(b, percent)
        i = np.flatnonzero(bits[(token & ((1 << SHARED_BITS) - 1)) >> 3] >> (token & 7).astype(np.uint8) & 1)
        node, component, size = (b.column(c).to_numpy(zero_copy_only=False)[row[i]] for c in range(3))
        parity = b.column(4).take(pa.array(row[i]))
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (token[i], node, component, size, at[i].astype(np.int64), short[i], probes[i])), parity], ["token", "node", "component", "n", "at", "short", "probes", "parity"])


def _meetings(prefixes: DataFrame, shared: DataFrame, percent: int, n: int) -> DataFrame:
    """(a, b), a < b: all pairs of different components that share a prefix shingle and can be similar enough.

    The rows of a common shingle are dealt into cells: short prefixes by ``si``, long ones by ``sp``.
    """
    bits = np.zeros(1 << SHARED_BITS >> 3, np.uint8)
    place = F.expr(f"token & {(1 << SHARED_BITS) - 1}")
    words = shared.groupBy(F.shiftright(place, 3).alias("word")).agg(F.bit_or(F.expr("shiftleft(1, cast(token & 7 AS int))")).alias("bits")).toArrow()
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    held = prefixes.sparkSession.sparkContext.broadcast(bits.tobytes())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spread(batches, percent, np.frombuffer(held.value, np.uint8))

    rows = prefixes.mapInArrow(spread, "token long, node long, component long, n long, at long, short boolean, probes boolean, parity binary").join(shared, "token")
    cells = lambda c: F.floor((F.col(c) - 1) / CELL) + 1
    own = lambda c: F.pmod(F.xxhash64("node"), F.greatest(cells(c), F.lit(1)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), cells(c) - 1))
    some = rows.where("short").select("token", own("ni").alias("si"), every("np").alias("sp"), F.lit(True).alias("short"), "node", "component", "n", "at", "parity")
    rest = rows.where("probes").select("token", every("ni").alias("si"), own("np").alias("sp"), F.lit(False).alias("short"), "node", "component", "n", "at", "parity")
    dealt = some.union(rest).repartition(n, "token", "si", "sp").sortWithinPartitions("token", "si", "sp")

    def cell(c: np.ndarray, parity: np.ndarray) -> Iterator[np.ndarray]:
        short = c[:, 3] == 1
        x, y, px, py = c[short], c[~short], parity[short], parity[~short]
        order = np.argsort(x[:, 5], kind="stable")
        x, px = x[order], px[order]
        ends = np.append(np.flatnonzero(np.append(True, x[1:, 5] != x[:-1, 5])), len(x))
        small = len(x) * len(y) <= SMALL  # all components at once
        if small:
            ends = np.array([0, len(x)])
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            others = np.arange(len(y)) if small else np.flatnonzero(y[:, 5] != x[lo, 5])
            other = y[others]
            step = max(1, MET // max(1, len(other)))
            for at in range(lo, hi if len(other) else lo, step):
                s = x[at : min(at + step, hi)]
                nx, ny = s[:, None, 6], other[None, :, 6]
                ok = ((nx < ny) | (nx == ny) & (s[:, None, 4] < other[None, :, 4])) & (100 * nx >= percent * ny)
                ok &= s[:, None, 5] != other[None, :, 5]
                ok &= (100 + percent) * np.minimum(nx - s[:, None, 7], ny - other[None, :, 7]) >= percent * (nx + ny)
                i, j = np.nonzero(ok)
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    n = s[a, 6] + other[b, 6]
                    differ = np.bitwise_count(px[at + a] ^ py[others[b]]).sum(1, dtype=np.int64)
                    may = differ <= n - 2 * _least(n, percent, 100 + percent)
                    if may.any():
                        yield np.sort(np.stack([s[a[may], 4], other[b[may], 4]]), 0)

    def once_each(held: list[np.ndarray]) -> np.ndarray:
        pairs = np.concatenate(held, 1)
        pairs = pairs[:, np.lexsort(pairs)]
        return pairs[:, np.append(True, (pairs[:, 1:] != pairs[:, :-1]).any(0))]

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = FOLDED // 64
        held, size = [], 0
        tail, tail_parity = np.zeros((0, 8), np.int64), np.zeros((0, words), np.uint64)
        for b in chain(batches, [None]):
            if b is not None:
                cols = [x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in b.columns[:8]]
                now = np.concatenate([tail, np.stack(cols, 1)])
                parity = np.concatenate([tail_parity, np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(-1, words)])
            else:
                now, parity = tail, tail_parity
            if not len(now):
                continue
            starts = np.flatnonzero(np.append(True, (now[1:, :3] != now[:-1, :3]).any(1)))
            ends = np.append(starts[1:], len(now))
            if b is not None:  # the last cell may go on
                tail, tail_parity, starts, ends = now[starts[-1] :], parity[starts[-1] :], starts[:-1], ends[:-1]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                for p in cell(now[s:e], parity[s:e]) if e - s > 1 else ():
                    held.append(p)
                    size += p.shape[1]
                    if size >= HELD:  # a pair that meets at many shingles of the task is one
                        held = [once_each(held)]
                        size = held[0].shape[1]
                        if size >= HELD // 2:
                            yield out(held[0])
                            held, size = [], 0
        if held:
            yield out(once_each(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _folded(rows: DataFrame) -> DataFrame:
    """The rows with parities of ``FOLDED`` bits: slots whose numbers differ by that are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [fold(x, FOLDED).tobytes() for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(short, pa.binary())], b.schema.names)

    return rows.mapInArrow(run, "node long, component long, n_shingles long, prefix binary, parity binary")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that do not differ in more parities than similar sets differ in shingles: by ``PARITY_BITS`` slots
    first, and those that are left by as many as the smaller set has."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([fold(x, PARITY_BITS).tobytes() for x in b.column(2).to_pylist()], pa.binary())], b.schema.names)

    one = sets.select("node", "n_shingles", "parity")
    brief = one.mapInArrow(short, "node long, n_shingles long, parity binary")
    return _apart(written(_apart(pairs, brief, percent), "alike"), one, percent)


def _apart(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False) + b.column(3).to_numpy(zero_copy_only=False)
            differ = np.zeros(b.num_rows, np.int64)
            for r, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                size = 8 * min(len(x), len(y))
                differ[r] = int.from_bytes((fold(x, size) ^ fold(y, size)).tobytes(), "little").bit_count()
            yield b.filter(pa.array(differ <= n - 2 * _least(n, percent, 100 + percent))).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among ``nodes``: a bit map of hashes, of a fixed greatest size, is sent to
    all tasks, so that only the texts that are compared are shuffled.  It lets some others pass and holds none back."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    words = nodes.select(place("node").alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
    bits = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
    asked = docs.withColumn("p", place("id")).withColumn("word", F.shiftright("p", 6))
    return asked.join(F.broadcast(bits), "word").where(F.expr("(bits & shiftleft(1L, cast(p & 63 AS int))) <> 0")).select("id", "text")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _wanted(docs, nodes).groupBy("id").agg(F.first("text").alias("text"))
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in bounded(batches, "left", CONFIRM, "right"):
                # The rows are sorted by b: equal texts stand together and are taken apart once.
                ids = b.column(1).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                right = shingles(b.column(3).take(pa.array(new)), k)
                at = np.cumsum(np.append(True, ids[1:] != ids[:-1])) - 1
                keep = []
                for x, r in zip(shingles(b.column(2), k), at.tolist(), strict=True):
                    y = right[r]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (the smallest id reachable), kept: one row for each row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets.  A text without words, or
    a null one, is linked with nothing.  Rows of one id are one document; rows of a null id follow the other documents
    of an equal set and are kept only where there is none.  Of equal sets the smallest id stands for all.  All links
    count: what the trees leave is found by the exact round.
    """
    return _grouped(df, k, percent, id_col, text_col).drop("key")


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each group, with all its columns: repeated rows of one id are one document, and rows of a
    null id with equal sets are copies of one another.  Each row of a null id and no words stays."""
    groups = _grouped(df, k, percent, id_col, text_col).where("kept").select(F.col(id_col).alias("i"), F.col("key").alias("k"))
    ids = groups.where("i IS NOT NULL").select("i").distinct()
    named = df.where(df[id_col].isNotNull()).dropDuplicates([id_col])
    named = named.join(ids, named[id_col] == ids["i"], "left_semi").select(*df.columns)
    row = df.where(df[id_col].isNull()).select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in bounded(batches, "text"):
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingles(b.column(1), k)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], ["row", "k"])

    nameless = row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, k binary")
    sets = groups.where("i IS NULL AND k IS NOT NULL").select("k").distinct()
    copies = nameless.where("k IS NOT NULL").groupBy("k").agg(F.first("row").alias("row")).join(sets, "k", "left_semi")
    return named.union(copies.select("row.*")).union(nameless.where("k IS NULL").select("row.*"))


def _grouped(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """What :func:`near_duplicates` returns, with the set's key."""
    sigs = written(signatures(df, k, percent, id_col, text_col), "signatures")
    docs = two(df, id_col, text_col).where("id IS NOT NULL")
    # Equal sets first: copies by the thousand are one class from here on.  Partial minima meet by key.
    classes = sigs.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "sig")).alias("m"))
    classes = written(classes.select("key", F.col("m.id").cast("long").alias("node"), F.col("m.sig").alias("sig")), "classes")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    labels, edges = None, None
    for trees, near in ROUNDS:
        nodes = classes.withColumn("component", F.col("node")) if labels is None else classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = written(_confirm(written(_candidates(nodes, trees, near, n), "candidates"), docs, k, percent), "links")
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    nodes = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    own = sigs.where("prefix IS NOT NULL AND id IS NOT NULL").select(F.col("id").cast("long").alias("node"), "n_shingles", "prefix", "parity").dropDuplicates(["node"])
    prefixes = written(_folded(nodes.join(own, "node").select("node", "component", "n_shingles", "prefix", "parity")), "prefixes")
    total = prefixes.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    shared = written(_shared(prefixes, percent, max(n, total // (8 * PART) + 1), n), "shared")
    met = _possible(written(_meetings(prefixes, shared, percent, n), "meetings"), own, percent)
    found = written(_confirm(written(met, "candidates"), docs, k, percent), "links")
    labels = components(edges.union(found))
    of = classes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    out = sigs.select("id", "n_shingles", "key").join(of, "key", "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), "key")
