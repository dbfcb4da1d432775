"""Nearest rows of a base table, by similarity, with ties to the smaller ordinal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..session import cut
from . import tiles as T
from .cells import PART_BITS, PROBES, Cells

QUERY_ROWS, BASE_ROWS = 256, 4096  # a block of similarities is 8 MB


def _best(q: np.ndarray, base: np.ndarray, ords: np.ndarray, skip: np.ndarray | None = None):
    """Per query row: best similarity and the position of the best base row (base sorted by ordinal).

    Worked off in blocks of similarities, so neither a long batch nor a large base needs more memory.
    """
    best, where = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    own = None if skip is None or not len(ords) else np.searchsorted(ords, skip)
    for s in range(0, len(q), QUERY_ROWS):
        rows = slice(s, min(s + QUERY_ROWS, len(q)))
        r = np.arange(rows.stop - s)
        for at in range(0, len(base), BASE_ROWS):
            sims = q[rows] @ base[at : at + BASE_ROWS].T
            if own is not None:
                place = own[rows] - at
                mine = np.flatnonzero((place >= 0) & (place < sims.shape[1]))
                mine = mine[ords[place[mine] + at] == skip[rows][mine]]
                sims[mine, place[mine]] = -np.inf
            top = sims.argmax(axis=1)
            v = sims[r, top]
            better = np.flatnonzero(v > best[rows])  # blocks come in ordinal order: an equal later row is no better
            best[s + better], where[s + better] = v[better], top[better] + at
    return best, where


def nearest(
    queries: DataFrame,
    base: DataFrame,
    exclude_self: bool = False,
    broadcast_bytes: int = T.BROADCAST_BYTES,
    rows: int = T.TILE_ROWS,
) -> DataFrame:
    """The most similar ``base`` row of every query: adds ``sim``, ``near`` (ordinal) and ``near_word``.

    ``queries`` has ``id`` (unique, any type) and ``vector``; ``base`` has ``ordinal``, ``word``, ``vector``.
    A query without a vector, or without another base row, has no neighbour: NULLs.  Base rows without a
    vector are no one's neighbour.  With ``exclude_self`` the query id is an ordinal of ``base`` and is not its own neighbour.  A base that
    is measured to be small is shipped to the tasks; otherwise the queries go through an index of the base.
    """
    queries = queries.select("id", "vector")
    base = base.select("ordinal", "word", "vector").filter("vector is not null")
    word_t = base.schema["word"].dataType.simpleString()
    id_t = queries.schema["id"].dataType.simpleString()
    measured = base.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n, d = int(measured[0]), int(measured[1] or 0)
    if n == 0:
        nothing = {"sim": "double", "near": "bigint", "near_word": word_t}
        return queries.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).drop("vector")

    schema = f"id {id_t}, sim double, near bigint, near_word {word_t}"

    if n * d * 8 <= broadcast_bytes:
        table = base.toArrow().sort_by("ordinal")
        held = queries.sparkSession.sparkContext.broadcast(
            (A.matrix(table.column("vector"))[0], A.column(table, "ordinal"), A.plain(table.column("word")))
        )

        def scan(batches):
            mat, ords, words = held.value
            for b in batches:
                empty = b.filter(pc.is_null(b.column(1)))
                if empty.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [empty.column(0), pa.nulls(empty.num_rows, pa.float64()), pa.nulls(empty.num_rows, pa.int64()), pa.nulls(empty.num_rows, words.type)],
                        names=["id", "sim", "near", "near_word"],
                    )
                b = b.filter(pc.is_valid(b.column(1)))
                if not b.num_rows:
                    continue
                q, _ = A.matrix(b.column(1))
                ids = A.column(b, "id") if exclude_self else None
                sim, at = _best(q, mat, ords, ids)
                found = np.isfinite(sim)
                pick = pa.array(at, pa.int64(), mask=~found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sim, pa.float64(), mask=~found), pa.array(ords, pa.int64()).take(pick), words.take(pick)],
                    names=["id", "sim", "near", "near_word"],
                )

        return queries.mapInArrow(scan, schema)

    return nearest_indexed(queries, base, exclude_self, rows).drop("compared")


def nearest_indexed(queries: DataFrame, base: DataFrame, exclude_self: bool = False, rows: int = T.TILE_ROWS, cells: int | None = None) -> DataFrame:
    """:func:`nearest` through an index of the base, and ``compared``: how many base rows each query was held against.

    A query is held against the cell of its nearest pivot first.  What it finds there bounds its answer from below, and
    only cells that can hold a row as similar are visited after that.  ``base`` has at least one row.
    """
    queries = queries.select("id", "vector")
    base = base.select("ordinal", "word", "vector").filter("vector is not null")
    word_t = base.schema["word"].dataType.simpleString()
    id_t = queries.schema["id"].dataType.simpleString()
    points = base.withColumnRenamed("vector", "visual")
    index = Cells(points, "ordinal", rows, cells, semantic=False)
    laid = index.assign(points)
    sizes = cut(laid.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_parts")))
    laid = laid.join(sizes, "_cell").withColumn("_part", F.pmod(F.xxhash64("ordinal"), F.col("_parts"))).drop("_parts")
    laid = cut(laid)
    asked = queries.filter("vector is not null").withColumnRenamed("vector", "visual")
    null = lambda t: F.lit(None).cast(t)
    schema = f"id {id_t}, sim double, near bigint, near_word {word_t}, compared bigint"

    def kernel(t: pa.Table) -> pa.Table:
        side = A.column(t, "_side")
        q, b = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)).sort_by("ordinal")
        ids = A.plain(q.column("id"))
        if not q.num_rows or not b.num_rows:
            none = [ids.slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int64()), A.plain(b.column("word")).slice(0, 0), pa.array([], pa.int64())]
            return pa.table(none, names=["id", "sim", "near", "near_word", "compared"])
        qm, bm = A.matrix(q.column("visual"))[0], A.matrix(b.column("visual"))[0]
        ords = A.column(b, "ordinal").astype(np.int64)
        own = ids.to_numpy(zero_copy_only=False) if exclude_self else None
        sims, ats = [], []
        for s in range(0, len(qm), T.STRIP_ROWS):
            e = s + T.STRIP_ROWS
            sim, at = _best(qm[s:e], bm, ords, None if own is None else own[s:e])
            sims.append(sim)
            ats.append(at)
        sim, at = np.concatenate(sims), np.concatenate(ats)
        found = np.isfinite(sim)
        pick = pa.array(at, pa.int64(), mask=~found)
        cols = [ids, pa.array(sim, pa.float64(), mask=~found), pa.array(ords).take(pick), A.plain(b.column("word")).take(pick), pa.array(np.full(len(qm), len(bm)))]
        return pa.table(cols, names=["id", "sim", "near", "near_word", "compared"])

    def meet(visits: DataFrame) -> DataFrame:
        """Best row and rows seen of each query over the cells ``_other`` it visits.

        The visitors of a cell are dealt into chunks by their number, so a cell is shipped no more often than they need.
        """
        visits = cut(visits)
        chunk = T.fitted(asked, rows, index.n)
        chunks = visits.groupBy("_other").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_chunks"))
        chunks = cut(chunks.join(sizes.select(F.col("_cell").alias("_other"), "_parts"), "_other"))
        where = visits.join(chunks, "_other").withColumn("_hi", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("bigint"))
        left = where.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
            "id", null("bigint").alias("ordinal"), null(word_t).alias("word"), "visual", F.col("_other").alias("_cell"), "_part", "_hi", F.lit(0).alias("_side"))
        needed = chunks.select(F.col("_other").alias("_cell"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks").cast("bigint") - 1)).alias("_hi"))
        right = laid.join(needed, "_cell").select(
            null(id_t).alias("id"), "ordinal", "word", "visual", "_cell", "_part", "_hi", F.lit(1).alias("_side"))
        both = left.unionByName(right).withColumn("_lo", F.shiftleft(F.col("_cell").cast("bigint"), PART_BITS) + F.col("_part"))
        return T.per_tile(both.drop("_cell", "_part"), [], kernel, schema)

    def meet_all() -> DataFrame:
        """The same where the cells skip too little: every query with every base row, in plain tiles."""
        left = asked.select("id", null("bigint").alias("ordinal"), null(word_t).alias("word"), "visual", F.xxhash64("id").alias("_key"))
        right = points.select(null(id_t).alias("id"), "ordinal", "word", "visual", F.xxhash64("ordinal").alias("_key"))
        return T.per_tile(T.cross_tiles(left, right, "_key", rows).drop("_key"), [], kernel, schema)

    def merged(parts: DataFrame) -> DataFrame:
        order = F.when(F.col("sim").isNotNull(), F.struct((-F.col("sim")).alias("s"), F.col("near").alias("o")))
        return parts.groupBy("id").agg(F.min_by(F.struct("sim", "near", "near_word"), order).alias("b"), F.sum("compared").alias("compared"))

    homes = cut(index.assign(asked))

    def bounded(first: DataFrame, of: DataFrame) -> DataFrame:
        bound = merged(first).select(F.col("id").alias("_of"), F.col("b.sim").alias("_bound"))
        return of.join(bound, F.col("id").eqNullSafe(F.col("_of")), "left").drop("_of")

    # what the bounds skip is measured on some queries first; that decides how the rows are laid out, not what is found
    some = cut(homes.filter(F.col("id").isNotNull()).orderBy(F.xxhash64("id")).limit(PROBES)) if index.cells > T.MANY_TILES else None
    if some is not None and index.plain(bounded(meet(some.withColumn("_other", F.col("_cell"))), some), "visual", "_bound"):
        best = merged(meet_all())
    else:
        first = cut(meet(homes.withColumn("_other", F.col("_cell"))))
        more = index.visits(bounded(first, homes), "visual", "_bound").filter("_other <> _cell")
        best = merged(first.unionByName(meet(more)))
    found = best.select(F.col("id").alias("_of"), "b.sim", "b.near", "b.near_word", "compared")
    out = queries.select("id").join(found, F.col("id").eqNullSafe(F.col("_of")), "left").drop("_of")
    return out.withColumn("compared", F.coalesce("compared", F.lit(0)))
