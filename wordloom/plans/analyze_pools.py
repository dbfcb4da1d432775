"""Pool reports: set analysis, confidence in both spaces, gaps between categories, model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import centroids as C
from ..operators import diversity as D
from ..operators import poolsets as P


def set_report(components: DataFrame, pools: list[str]) -> dict[str, DataFrame]:
    return {
        "sizes": P.pool_sizes(components, pools),
        "overlap": P.pool_overlap(components),
        "agreement": P.category_agreement(components),
        "disagreements": P.category_disagreements(components),
        "consensus": P.consensus(components, pools[0]),
        "unique": P.unique_words(components),
    }


def confidence_report(words: DataFrame, pools: list[str]) -> dict[str, DataFrame]:
    """``words`` has pool, category, ordinal, word, visual, semantic.  The scored words are computed once."""
    conf = C.word_confidence(words).persist()
    cats, shares = C.confidence_by_category(conf), C.quadrant_shares(conf)
    return {
        "words": conf,
        "categories": cats,
        "quadrants": shares,
        "flagged": C.flagged(conf),
        "flag_counts": C.flag_counts(conf),
        "weakest": C.weakest_flags(conf),
        "visual_by_pool": C.confidence_pivot(cats, pools, "visual_mean"),
        "semantic_by_pool": C.confidence_pivot(cats, pools, "semantic_mean"),
        "quadrants_by_pool": C.quadrant_pivot(shares, pools),
    }


def gap_report(words: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    return {
        "centroids": C.centroid_pairs(words),
        "closest": C.category_extremes(words, k, True),
        "most_distant": C.category_extremes(words, k, False),
        "disagreements": C.space_disagreement(words, 15),
        "isolation": C.isolation(words),
    }


def model_report(words: DataFrame, spaces: dict[str, str]) -> dict[str, DataFrame]:
    stats = D.by_model(D.models_as_rows(words, spaces))
    return {
        "stats": stats,
        "pivot": D.model_pivot(stats, list(spaces)),
        **{f"inter_{m}": C.centroid_summary(words, s) for m, s in spaces.items()},
    }


def space_report(words: DataFrame, threshold: float = 0.85, k: int = 5) -> dict[str, DataFrame]:
    """How independent the two spaces are."""
    return {
        "correlation": D.space_correlation(words),
        "redundancy": D.redundancy_agreement(words, threshold),
        "visual_closer": D.pair_disagreement(words, k, True),
        "semantic_closer": D.pair_disagreement(words, k, False),
    }


def diversity_report(words: DataFrame, alpha: float = 0.5, threshold: float = 0.85, k: int = 15) -> dict[str, DataFrame]:
    found = C.contamination(words, alpha)
    return {"diversity": D.diversity(words, "joint", alpha, threshold), "contamination": C.worst_contamination(found, k)}
