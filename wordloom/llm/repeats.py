"""Long repeated passages by compaction of a de Bruijn graph of word windows.

An edge is the sequence of ``window`` words at one place.  Edges that occur twice or more are wanted, with all the words
they cover.

* Most edges occur once and are never shuffled: a window holds a least shingle of ``GRAM`` words (its minimizer), equal
  windows hold equal ones at equal places, so only windows whose minimizer occurs at two places or more can repeat.
* Equal texts are one node of all that follows, with a number of copies.
* Every text that may hold a repeat gets a stretch of coordinates, and an edge the least coordinate where it occurs as
  its home.  A join gives each occurrence its home, and neighbouring edges whose homes are neighbours are one fragment.
  Where a fragment begins or ends the graph branches, so the homes are cut there: the pieces between two cuts are the
  nonbranching paths of the graph, and fragments are rows of whole pieces.  One row stands for a path of any length.
* The pieces' words are read back from the texts at their coordinates and compared by 128-bit digests.  Edges are told
  apart by 64 bits until then; pieces that differ are taken apart into windows and counted anew by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

WINDOW, GRAM = 35, 8
SPACE = "[ \\t-\\r]+"
#: Coordinates that one task may give out: bytes of its texts, a terabyte.
TASK_BITS = 40
_P = 0x9E3779B97F4A7C15


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, one after the other, and where each text's begin (with the end of the last)."""
    parts = pc.split_pattern_regex(texts, SPACE)
    flat = parts.flatten()
    full = pc.not_equal(flat, "")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    doc = doc[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.searchsorted(doc, np.arange(len(texts) + 1), "left")


def joined(texts: pa.Array) -> pa.Array:
    """Each text's words joined by one space."""
    return pc.utf8_trim(pc.replace_substring_regex(texts, SPACE, " "), " ")


def hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = pc.dictionary_encode(flat)
    known = coded.dictionary.to_pylist()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of ``k`` neighbouring words at every place where so many follow, by doubling."""
    out, size, part, step = None, 0, h, 1
    while True:
        if k & step:
            n = len(h) - size - step + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = part[:n] if out is None else out[:n] * np.uint64(pow(_P, step, 1 << 64)) + part[size : size + n]
            size += step
        if size == k:
            return _mixed(out)
        n = max(len(h) - 2 * step + 1, 0)
        part = part[:n] * np.uint64(pow(_P, step, 1 << 64)) + part[step : step + n]
        step *= 2


def least(g: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` neighbours, where the first of their least values stands."""
    at, size = np.arange(len(g)), 1
    while size < w:
        step = min(size, w - size)
        if len(at) <= step:
            return np.zeros(0, np.int64)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        size += step
    return at


def _windows(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, place of the minimizer) of every window that lies within one text, and all shingle hashes."""
    g = rolled(h, min(GRAM, window))
    at = least(g, window - min(GRAM, window) + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + window <= starts[1:][doc])
    return inside, doc[inside], at[inside], g


def _minimizers(texts: DataFrame, window: int) -> DataFrame:
    """(h, text): one row for each place that is the minimizer of some window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in bounded(batches, "text"):
                flat, starts = words(b.column(1))
                _, doc, at, g = _windows(hashes(flat), starts, window)
                if len(at):
                    new = np.append(True, at[1:] != at[:-1])  # a shingle lies in one text, so its place tells texts apart
                    keys = b.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(g[at[new]].view(np.int64)), pa.array(keys[doc[new]])], ["h", "short"])

    return texts.select("short", "text").mapInArrow(run, "h long, short long")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with ``base``: coordinates ``base .. base + number of words`` are the text's alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << TASK_BITS
        for b in batches:
            if b.num_rows:
                size = pc.binary_length(b.column(b.schema.get_field_index("text"))).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array(base + ends - size), *b.columns], ["base", *b.schema.names])
                base += int(ends[-1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"base long, {schema}")


def _edges(held: DataFrame, window: int) -> DataFrame:
    """(e, at, pos, copies): the windows whose minimizer is among the text's repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in bounded(batches, "text"):
                flat, starts = words(b.column(1))
                h = hashes(flat)
                start, doc, at, g = _windows(h, starts, window)
                own = g[at].view(np.int64)
                ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
                lists = b.column(3)
                keep = np.zeros(len(start), bool)
                for r in range(b.num_rows):
                    s = slice(ends[r], ends[r + 1])
                    keep[s] = np.isin(own[s], lists[r].values.to_numpy())
                start, doc = start[keep], doc[keep]
                pos = start - starts[doc]
                base, copies = (b.column(c).to_numpy(zero_copy_only=False)[doc] for c in (0, 2))
                e = rolled(h, window)[start].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(base + pos), pa.array(pos.astype(np.int32)), pa.array(copies)], ["e", "at", "pos", "copies"])

    return held.select("base", "text", "copies", "hs").mapInArrow(run, "e long, at long, pos int, copies long")


def _fragments(rows: DataFrame, n: int) -> DataFrame:
    """(base, pos, n, hbase, hpos): runs of neighbouring occurrences with neighbouring homes.

    A run that two batches share is two fragments; that makes one more cut and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, pos, home, hpos = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (home[1:] != home[:-1] + 1)))
                size = np.diff(np.append(new, len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((at - pos)[new], pos[new], size, (home - hpos)[new], hpos[new])], ["base", "pos", "n", "hbase", "hpos"])

    dealt = rows.select("at", "pos", "home", "hpos").repartition(n, F.expr("at - pos")).sortWithinPartitions("at")
    return dealt.mapInArrow(run, "base long, pos long, n long, hbase long, hpos long")


def _pieces(fragments: DataFrame) -> DataFrame:
    """The fragments taken apart at all places where some fragment of the same home begins or ends."""
    ends = fragments.select("hbase", "hpos").union(fragments.select("hbase", F.expr("hpos + n"))).distinct()
    cuts = written(ends.groupBy("hbase").agg(F.array_sort(F.collect_list("hpos")).alias("cuts")), "cuts")
    own = fragments.join(cuts, "hbase").withColumn("c", F.expr("filter(cuts, x -> x >= hpos AND x <= hpos + n)"))
    each = own.withColumn("k", F.explode(F.expr("sequence(1, size(c) - 1)")))
    return each.select("base", F.expr("pos + c[k - 1] - hpos").alias("pos"), F.expr("c[k] - c[k - 1]").alias("n"), "hbase", F.expr("c[k - 1]").alias("hpos"))


def _read(held: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(base, key, copies, spans, kept, marks): each text without the words of its pieces, and the pieces with
    digests of their words."""
    lists = pieces.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "hbase", "hpos"))).alias("list"))
    rows = held.select("base", "key", "copies", "text").join(lists, "base")
    mark = pa.struct([(c, pa.int64()) for c in ("pos", "n", "hbase", "hpos", "d1", "d2")])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            plain, lists, out = joined(b.column(3)), b.column(4).to_pylist(), []
            for r, found in enumerate(lists):
                whole = plain[r].as_buffer().to_pybytes()
                at = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 32) + 1, [len(whole) + 1]])
                n = len(at) - 1
                cover, marks = np.zeros(n + 1, np.int64), []
                for p in found:
                    i, j = p["pos"], p["pos"] + p["n"] + window - 1
                    cover[i] += 1
                    cover[j] -= 1
                    digest = hashlib.blake2b(whole[at[i] : at[j] - 1], digest_size=16).digest()
                    marks.append(p | dict(zip(("d1", "d2"), np.frombuffer(digest, np.int64).tolist(), strict=True)))
                gone = np.append(np.cumsum(cover)[:-1] > 0, False)
                edge = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8)))
                spans = [{"start": int(i), "end": int(j)} for i, j in zip(edge[::2], edge[1::2], strict=True)]
                stays = [0, *(x for s in spans for x in (s["start"], s["end"])), n]
                kept = b" ".join(whole[at[i] : at[j] - 1] for i, j in zip(stays[::2], stays[1::2], strict=True) if j > i)
                out.append((spans, kept, marks))
            spans, kept, marks = zip(*out, strict=True)
            cols = [pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(marks, pa.list_(mark))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["base", "key", "copies", "spans", "kept", "marks"])

    schema = "base long, key binary, copies long, spans array<struct<start:long,end:long>>, kept string, marks array<struct<pos:long,n:long,hbase:long,hpos:long,d1:long,d2:long>>"
    return rows.select("base", "key", "copies", "text", "list").mapInArrow(run, schema)


def _verified(read: DataFrame, held: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """``read`` with pieces that are not equal to their home's words counted anew, window by window."""
    marks = read.select("base", "copies", F.explode("marks").alias("m")).select("base", "copies", "m.*")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)]
    odd = written(marks.groupBy("hbase", "hpos").agg(*ends).where("min_d1 <> max_d1 OR min_d2 <> max_d2").select("hbase", "hpos"), "odd")
    if not odd.limit(1).count():
        return read
    single = F.explode(F.expr("sequence(0L, n - 1)")).alias("k")
    apart = pieces.join(odd, ["hbase", "hpos"]).select("base", "pos", "hbase", "hpos", single)
    apart = apart.select("base", F.expr("pos + k").alias("pos"), F.lit(1).cast("long").alias("n"), "hbase", F.expr("hpos + k").alias("hpos"))
    seen = _read(held, apart, window).select("base", "copies", F.explode("marks").alias("m")).select("base", "copies", "m.*")
    seen = written(seen, "windows")
    good = seen.groupBy("hbase", "hpos", "d1", "d2").agg(F.sum("copies").alias("total")).where("total >= 2")
    good = seen.join(good, ["hbase", "hpos", "d1", "d2"]).select("base", "pos", "n", "hbase", "hpos")
    touched = apart.select("base").distinct()
    again = pieces.join(touched, "base", "left_semi").join(odd, ["hbase", "hpos"], "left_anti").select("base", "pos", "n", "hbase", "hpos").union(good)
    return read.join(touched, "base", "left_anti").union(_read(held, again, window))


def repeats(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id_col``, n_words, n_removed, spans, kept, kept_sha256[, ``carry``]: one row for each row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window is ``window`` neighbouring words of one text; every word of
    a window whose words also begin anywhere else, in the same text too, is removed.  ``spans`` are the removed stretches
    of words (from 0, end exclusive), ``kept`` the other words joined by one space, null where nothing goes and the text
    stands; ``kept_sha256`` is the digest of the kept words joined by one space in either case.  All is judged on the input.  Rows are texts, whatever their ids: null ids and rows repeated with an id count
    as they stand, so a row that is there twice loses all words that windows cover.  A null text has no words; texts of
    fewer than ``window`` words lose none; an empty table gives no rows.  Columns other than the id, the text and those
    named in ``carry`` stay behind; those of ``carry`` must not be named like the columns returned.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text.cast("binary"), 256))
    texts = df.select(key.alias("key"), text.alias("text")).withColumn("short", F.xxhash64("key"))
    places = written(_minimizers(texts, window), "minimizers")
    several = written(places.groupBy("h").count().where("count > 1").select("h"), "repeated")
    # ``short`` may be shared by two texts at worst; each then has some minimizers that it doesn't hold.
    hits = places.join(several, "h").groupBy("short").agg(F.collect_set("h").alias("hs"))
    hits = hits.join(texts.select("short", "key").distinct(), "short").select("key", "hs")
    distinct = texts.select("key", "text").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    held = written(_placed(distinct.join(hits, "key").select("key", "text", "copies", "hs")), "texts")
    edges = written(_edges(held, window), "edges")
    homes = edges.groupBy("e").agg(F.sum("copies").alias("total"), F.min("at").alias("home"), F.min_by("pos", "at").alias("hpos"))
    homes = written(homes.where("total > 1").select("e", "home", "hpos"), "homes")
    fragments = written(_fragments(edges.select("e", "at", "pos").join(homes, "e"), n), "fragments")
    pieces = written(_pieces(fragments), "pieces")
    read = written(_read(held, pieces, window), "read")
    read = _verified(read, held, pieces, window).select("key", "spans", "kept").where("size(spans) > 0")
    own = F.struct(df[id_col].alias("i"), *[df[c].alias(f"carry_{c}") for c in carry or ()])
    counted = _whole(df.select(own.alias("own"), key.alias("key"), text.alias("text"))).select("own.*", "key", "n_words", "whole")
    out = counted.join(written(read, "removed"), "key", "left")
    gone = F.coalesce(F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)"), F.lit(0)).cast("long")
    none = F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)")
    digest = F.coalesce(F.sha2("kept", 256), "whole").alias("kept_sha256")
    return out.select(F.col("i").alias(id_col), "n_words", gone.alias("n_removed"), F.coalesce("spans", none).alias("spans"), "kept", digest, *[F.col(f"carry_{c}").alias(c) for c in carry or ()])


def _whole(rows: DataFrame) -> DataFrame:
    """(own, key, n_words, whole): how many words each text has, and the digest of all of them joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            plain = joined(b.column(2))
            n = pc.if_else(pc.equal(plain, ""), 0, pc.add(pc.count_substring(plain, " "), 1)).cast(pa.int64())
            whole = [hashlib.sha256(x.as_buffer()).hexdigest() for x in plain]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(whole)], ["own", "key", "n_words", "whole"])

    return rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, key binary, n_words long, whole string")
