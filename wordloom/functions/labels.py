"""Labels and scores that are plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quadrant names in report order.
QUADRANTS = ("rock_solid", "visual_anchor", "semantic_anchor", "weak")
# Run lengths that are announced.
MILESTONES = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def quadrant(category, own_visual, best_visual, visual_says, own_semantic, best_semantic, semantic_says) -> Column:
    """Which spaces accept the word in its category."""
    visual_ok = (own_visual > best_visual * 0.85) | (visual_says == category)
    semantic_ok = (own_semantic > best_semantic * 0.85) | (semantic_says == category)
    return (
        F.when(visual_ok & semantic_ok, "rock_solid")
        .when(visual_ok, "visual_anchor")
        .when(semantic_ok, "semantic_anchor")
        .otherwise("weak")
    )


def verdict(delta_mean: Column) -> Column:
    """Lower mean similarity is better."""
    return F.when(delta_mean < -0.005, "better").when(delta_mean > 0.005, "worse").otherwise("same")


def dominant_space(alpha: Column) -> Column:
    return F.when(alpha > 0.55, "visual").when(alpha < 0.45, "semantic").otherwise("balanced")


def spread_score(mean: Column, value_range: Column) -> Column:
    return (F.lit(1.0) - mean) * 0.6 + value_range * 0.4


def gated_scores(v_mean, v_range, v_cross, s_mean, s_range, s_cross) -> dict[str, Column]:
    """Internal score: least of both spaces; uniqueness: greatest; combined: their mean."""
    internal = F.least(spread_score(v_mean, v_range), spread_score(s_mean, s_range))
    unique = F.greatest(F.lit(1.0) - v_cross, F.lit(1.0) - s_cross)
    return {
        "visual_internal_score": spread_score(v_mean, v_range),
        "semantic_internal_score": spread_score(s_mean, s_range),
        "visual_uniqueness": F.lit(1.0) - v_cross,
        "semantic_uniqueness": F.lit(1.0) - s_cross,
        "internal_score": internal,
        "uniqueness_score": unique,
        "combined_score": internal * 0.5 + unique * 0.5,
    }


def coverage_percent(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") / total.cast("double") * 100).otherwise(F.lit(0.0))


def log_progress(count: Column, total: Column) -> Column:
    """Share of the space on a log scale, at most 1."""
    raw = F.log10(count.cast("double") + 1) / F.log10(total.cast("double"))
    return F.when((total > 1) & (count > 0), F.least(raw, F.lit(1.0))).otherwise(F.lit(0.0))


def progress_cells(progress: Column, width: int = 32) -> Column:
    return F.floor(progress * width).cast("int")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
