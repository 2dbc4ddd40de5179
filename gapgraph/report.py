"""Console reports over a graph document: summary, top gaps, hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gapgraph.functions.text import shorten, two_digits


def summary(document: DataFrame) -> DataFrame:
    """One row: papers, claims, nodes, edges, gaps, hypotheses."""
    return document.select(F.col("papers_analyzed").alias("papers"), *(F.size(c).alias(c) for c in ("claims", "nodes", "edges", "gaps", "hypotheses")))


def gaps_report(document: DataFrame, top: int = 10, width: int = 80) -> DataFrame:
    """The best gaps of a document: rank, variable, kind, score and shortened explanation."""
    rows = document.select(F.posexplode("gaps").alias("ord", "g")).select("ord", "g.*")
    best = rows.orderBy(F.desc("gap_score"), "ord").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("gap_score"), "ord"))
    return best.select(rank.alias("rank"), "variable", "gap_type", two_digits(F.col("gap_score")).alias("score"), shorten(F.col("gap_explanation"), width).alias("explanation"))


def hypotheses_report(document: DataFrame, top: int = 5, width: int = 100) -> DataFrame:
    """The first hypotheses of a document, in stored order."""
    rows = document.select(F.posexplode("hypotheses").alias("ord", "h")).select("ord", "h.*")
    return rows.orderBy("ord").limit(top).select("id", "gap_addressed.variable", shorten(F.col("hypothesis_text"), width).alias("hypothesis"), two_digits(F.col("testability_score")).alias("testability"), two_digits(F.col("novelty_score")).alias("novelty"), shorten(F.col("suggested_experiment"), width).alias("experiment"))
