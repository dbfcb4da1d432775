"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in ``k = m * RATE`` edits.  Cut into k + 1 pieces, one of them is untouched in
any such copy; so all pieces of all items are looked up exactly, in one automaton, and each hit is verified around its
place by Myers' bit-parallel edit distance.  Nothing within the budget is missed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, once

#: Edits for each character; an item of fewer characters must stand between word borders, and :func:`clean` does not drop
#: a text for it alone; bytes of items in a block.
RATE, LEAST, BLOCK_BYTES = 0.05, 20, 4 << 20


def normal(text: str) -> str:
    """Lower case, one space for any white space."""
    return " ".join(text.lower().split())


class Pattern:
    """One item's bit masks, forwards and backwards."""

    def __init__(self, text: str, budget: int):
        self.text, self.m, self.budget = text, len(text), budget
        self.ahead, self.back = self._masks(text), self._masks(text[::-1])

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << k
        return out

    def _best(self, masks: dict[str, int], text: str, anchored: bool) -> tuple[int, int]:
        """(least distance to a part of ``text``, its last place); anchored: parts that begin where the text begins."""
        m = self.m
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        best, at = m, 0
        get = masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & full
            pv = (mh << 1 & full) | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, at = score, j
        return best, at

    def find(self, text: str, start: int, end: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the closest part of ``text[start:end]`` within the budget."""
        d, to = self._best(self.ahead, text[start:end], False)
        if d > self.budget:
            return None
        _, n = self._best(self.back, text[start : start + to][::-1], True)
        return d, start + to - n, start + to


def _inside(text: str, at: int) -> bool:
    """Does a place lie within a word?  Scripts without spaces have no such places."""
    return 0 < at < len(text) and all(c.isalnum() and ord(c) < 0x2E80 for c in text[at - 1 : at + 1])


@dataclass
class Items:
    """The items of one block, as the tasks get them."""

    ids: list
    texts: list[str]
    rate: float = RATE

    def build(self) -> None:
        self.patterns, self.machine = [], ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            p = Pattern(t, int(len(t) * self.rate))
            self.patterns.append(p)
            n = p.budget + 1
            for i in range(n):
                a, b = i * p.m // n, (i + 1) * p.m // n
                found.setdefault(t[a:b], []).append((k, b))
        for piece, where in found.items():
            self.machine.add_word(piece, where)
        if found:
            self.machine.make_automaton()

    def leaks(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) of the items in a normal text: the first closest part of each."""
        if not self.patterns or not text:
            return []
        tried: dict[int, list[int]] = {}
        for end, where in self.machine.iter(text):
            for k, b in where:
                tried.setdefault(k, []).append(end + 1 - b)  # where the item would begin
        out = []
        for k, begins in tried.items():
            p = self.patterns[k]
            best = None
            begins.sort()
            if p.m < LEAST:  # no edits: its one piece is all of it
                best = next(((0, a, a + p.m) for a in begins if not _inside(text, a) and not _inside(text, a + p.m)), None)
                begins = []
            i = 0
            while i < len(begins):
                # Neighbouring beginnings share a window.
                a = b = begins[i]
                while i < len(begins) and begins[i] <= b + p.budget:
                    b = begins[i]
                    i += 1
                got = p.find(text, max(0, a - p.budget), b + p.m + p.budget)
                if got and (best is None or got[0] < best[0]):
                    best = got
            if best:
                out.append((self.ids[k], *best))
        return sorted(out, key=lambda x: (x[2], x[3], str(x[0])))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, rate: float) -> Iterator[Items]:
    """The items, ``BLOCK_BYTES`` at a time, so that a large benchmark is more passes and never a larger broadcast."""
    rows = benchmark.where(benchmark[text_col].isNotNull()).select(benchmark[id_col].alias("i"), benchmark[text_col].cast("string").alias("t")).distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        texts = sorted((normal(r["t"]), r["i"]) for r in part if r["i"] is not None) + sorted((normal(r["t"]), None) for r in part if r["i"] is None)
        texts = [(t, i) for t, i in texts if t]
        yield Items([i for _, i in texts], [t for t, _ in texts], rate)


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``df`` as a struct ``row``, and ``leaks``: array of (item, distance, start, end), empty for clean rows.

    Start and end are places in the text in lower case with single spaces.  Whole texts are searched; a null text has
    no leaks; null and repeated items are items, empty ones none; items under ``LEAST`` characters are found where they stand
    exactly, between word borders; repeated rows are judged alike.
    With an empty benchmark all leaks are empty.  One pass over the texts for each block of items; no shuffle.
    """
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    kind, key = out.schema["row"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    leaks = f"array<struct<item: {key}, distance: bigint, start: bigint, end: bigint>>"
    spark = df.sparkSession
    out = out.select("row", "text", F.array().cast(leaks).alias("leaks"))
    for items in _blocks(benchmark, item_id, item_text, rate):
        shared = spark.sparkContext.broadcast((os.urandom(12).hex(), items.ids, items.texts, items.rate))
        step = out.mapInArrow(_search(shared), f"row {kind}, text string, leaks {leaks}")
        out = step
    return out.select("row", "leaks")


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, *parts = shared.value
        slot = once("leak-items", dict)  # one automaton a worker, not one a task
        if slot.get("tag") != tag:
            slot.clear()
            items = Items(*parts)
            items.build()
            slot.update(tag=tag, items=items)
        items = slot["items"]
        for b in bounded(batches, "text"):
            before, more = b.column(2).to_pylist(), []
            for text, had in zip(b.column(1).to_pylist(), before, strict=True):
                more.append(had + [dict(zip(("item", "distance", "start", "end"), x, strict=True)) for x in items.leaks(normal(text))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, b.column(2).type)], ["row", "text", "leaks"])

    return run


def pairs(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``id_col``, item_id, distance, start, end: a row for each item that a row of ``df`` holds; clean rows have none."""
    own = df.select(df[id_col], df[how.get("text_col", "text")])
    hit = find(own, benchmark, **how).where(F.size("leaks") > 0)
    return hit.select(F.col(f"row.{id_col}").alias(id_col), F.inline("leaks")).withColumnRenamed("item", "item_id")


def clean(df: DataFrame, benchmark: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """The rows of ``df`` that hold no item of ``least`` characters or more, with all their columns: a shorter one, a
    single word say, is found by :func:`find` but is no evidence that a text was copied."""
    long = F.filter("leaks", lambda x: x["end"] - x["start"] >= F.lit(least - int(least * how.get("rate", RATE))))
    return find(df, benchmark, **how).where(F.size(long) == 0).select("row.*")
