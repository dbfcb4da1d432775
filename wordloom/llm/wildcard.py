"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit for each state of each rule.  A byte of the URL moves
every rule at once: ``D = ((D << 1) & step[byte]) | (D & stay[byte])``, with carries from word to word.  ``*`` is any
run of bytes, ``^`` a run without ``/``, ``?`` and ``#`` (a piece of the host); all else, ``?`` too, stands for itself.
A ``*`` costs no state: it lets the state before it stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows; of the matching rules with the greatest ``rank`` the longest name wins."""

    name: str
    glob: str
    verdict: str
    rank: int = 0


def site(rule: str, verdict: str) -> Rule:
    """A rule of a host and a path, like ``example.net/en/``: the host, its subdomains and paths that start so."""
    return Rule(rule, f"^.{rule}*", verdict, 1)


#: Sites first; listings, feeds, log-ins and downloads of any site after them.
RULES = (
    site("net/", "block"),
    site("example.net/en/", "allow"),
    site("example.com/de/", "block"),
    site("org/fr/", "allow"),
    Rule("listing", "*?page=*", "block"),
    Rule("feed", "*?utm_source=feed*", "block"),
    Rule("login", "*/wp-login*", "block"),
    Rule("advert", "^/ads/*", "block"),
    Rule("program", "*.exe", "block"),
)


class Automaton:
    """The packed rules."""

    def __init__(self, globs: list[str]):
        kinds: list[tuple[int, int]] = []  # (bit, byte that leads to it), -1 at the start of a rule
        loops: list[tuple[int, str]] = []
        starts, ends = [], []
        bit = -1
        for g in globs:
            bit += 1
            starts.append(bit)
            kinds.append((bit, -1))
            for c in g.encode():
                if c in b"*^":
                    loops.append((bit, chr(c)))
                else:
                    bit += 1
                    kinds.append((bit, c))
            ends.append(bit)
        self.words = max(1, -(-(bit + 1) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.ends = [(e // 64, np.uint64(e % 64)) for e in ends]
        one = lambda k: np.uint64(1) << np.uint64(k % 64)
        for k, c in kinds:
            if c >= 0:
                self.step[c, k // 64] |= one(k)
        host = np.array([c not in b"/?#" for c in range(256)])
        for k, kind in loops:
            self.stay[slice(None) if kind == "*" else host, k // 64] |= one(k)
        for k in starts:
            self.first[k // 64] |= one(k)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each rule: does the rule fit the whole URL?"""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        longest_first = -lengths[order]
        state = np.repeat(self.first[None, :], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(longest_first, -j, "left"))  # URLs with more than j bytes
            byte = data[starts[:n] + j]
            now = state[:n]
            moved = now << one
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.stay[byte])
        found = np.zeros((len(urls), len(self.ends)), bool)
        for r, (w, b) in enumerate(self.ends):
            found[order, r] = (state[:, w] >> b) & one != 0
        return found


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query.  A null, or a text without ``://``, gives three empty texts."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1),
    )


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, host, path, rule (of the highest rank, else null), verdict, pattern: one row for each row of ``pages``.

    ``rule`` names a matching site rule; ``pattern`` names whichever rule gave the verdict.  No rule: allow.
    Null, empty and odd URLs have empty host and path.  Repeated rows and null ids are judged like any other; other
    columns are not carried.  Of rules of one rank and length the first listed wins.  The rules travel with the tasks:
    they are a setting of a few kilobytes, not data.
    """
    host, path, query = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), F.concat(F.lit("."), host, path, query).alias("canonical"))
    key = pages.schema[id_col].dataType
    best = sorted(range(len(rules)), key=lambda r: (-rules[r].rank, -len(rules[r].name), r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([r.glob for r in rules])
        for b in bounded(batches, "canonical"):
            found = machine.matches([x.encode() for x in b.column(3).to_pylist()])
            any_rule = found.any(1)
            pick = np.array(best)[found[:, best].argmax(1)]
            won = [rules[p] if hit else None for p, hit in zip(pick, any_rule, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:3],
                    pa.array([w.name if w and w.rank else None for w in won], pa.string()),
                    pa.array([w.verdict if w else "allow" for w in won], pa.string()),
                    pa.array([w.name if w else None for w in won], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict", "pattern"],
            )

    out = rows.mapInArrow(run, f"id {key.simpleString()}, host string, path string, rule string, verdict string, pattern string")
    return out.withColumnRenamed("id", id_col)
