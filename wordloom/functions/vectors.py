"""Vector columns: unit length, dot product, and the gates that join two spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def dot(a: Column, b: Column) -> Column:
    """Dot product; equals the cosine for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), _zero(), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, _zero(), lambda s, x: s + _d(x) * _d(x)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays as it is."""

    def scaled(w: Column) -> Column:
        length = F.when(norm(w) > 0, norm(w)).otherwise(1.0)
        return bind(length, lambda n: F.transform(w, lambda x: _d(x) / n))

    return bind(v, scaled)


def joint(sim_visual: Column, sim_semantic: Column, alpha: float = 0.5) -> Column:
    """Weighted blend of two similarities; the visual one alone where the semantic one is missing."""
    return F.when(sim_semantic.isNull(), sim_visual).otherwise(
        F.lit(alpha) * sim_visual + F.lit(1.0 - alpha) * sim_semantic
    )


def either_similar(sim_visual: Column, sim_semantic: Column) -> Column:
    """Redundancy gate: alike in either space."""
    return F.greatest(sim_visual, sim_semantic)


def either_distinct(sim_visual: Column, sim_semantic: Column) -> Column:
    """Selection gate: distinct in either space."""
    return F.least(sim_visual, sim_semantic)


def semantic_or_visual(sim_visual: Column, sim_semantic: Column) -> Column:
    return F.coalesce(sim_semantic, sim_visual)


def interpolate(a: Column, b: Column, t: Column) -> Column:
    """Point ``t`` of the way from ``a`` to ``b``, back on the unit sphere."""
    return unit(F.zip_with(a, b, lambda x, y: (F.lit(1.0) - t) * _d(x) + t * _d(y)))


def pole(v: Column) -> Column:
    """Direction of the first three entries; a zero direction stays zero."""
    return unit(F.slice(v, 1, 3))
