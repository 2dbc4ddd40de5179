"""Scores of gaps and hypotheses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weight of each kind of gap, and of a kind that is not listed (fixed values).
TYPE_WEIGHTS = {"MISSING_CAUSE": 0.75, "MISSING_EFFECT": 0.65, "ISOLATED_NODE": 0.45, "LOW_CONFIDENCE_CHAIN": 0.60, "BROKEN_CHAIN": 0.70}
DEFAULT_WEIGHT = 0.5
#: Shares of connectivity, papers and kind in a gap's score, and the sums at which the first two reach 1 (fixed values).
SHARES = (0.40, 0.30, 0.30)
FULL_DEGREE = 20
FULL_PAPERS = 10
#: Shares of testability, novelty and gap score in a hypothesis's score (fixed values).
HYPOTHESIS_SHARES = (0.4, 0.4, 0.2)


def type_weight(kind: Column) -> Column:
    out = None
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight) if out is None else out.when(kind == name, weight)
    return out.otherwise(DEFAULT_WEIGHT)


def connectivity(neighbour_degrees: Column) -> Column:
    return F.log1p(neighbour_degrees.cast("double")) / F.log1p(F.lit(float(FULL_DEGREE)))


def paper_support(papers: Column) -> Column:
    return F.log1p(papers.cast("double")) / F.log1p(F.lit(float(FULL_PAPERS)))


def gap_score(neighbour_degrees: Column, papers: Column, kind: Column) -> Column:
    """Weighted sum, clipped to [0, 1]."""
    a, b, c = SHARES
    raw = a * connectivity(neighbour_degrees) + b * paper_support(papers) + c * type_weight(kind)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def composite_score(testability: Column, novelty: Column, gap: Column) -> Column:
    a, b, c = HYPOTHESIS_SHARES
    return a * testability + b * novelty + c * gap
