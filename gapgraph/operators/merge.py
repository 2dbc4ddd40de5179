"""Merging claims into edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapgraph.functions.text import is_placeholder, node_name, trim_space

#: Confidences are summed as whole millionths, so a mean does not depend on the order of rows.
UNIT = 1_000_000


def normalize_claims(claims: DataFrame) -> DataFrame:
    """Claims with normalised names; those from a name to itself go."""
    return claims.withColumns({"cause": node_name(F.col("cause")), "effect": node_name(F.col("effect"))}).filter(F.col("cause") != F.col("effect"))



def _texts(claims: DataFrame, value: Column, key: Column, name: str) -> DataFrame:
    """Per (cause, effect) the non-empty values, one for each key, in order of first appearance."""
    rows = claims.select("cause", "effect", "claim_seq", value.alias("v")).filter(F.length("v") > 0)
    once = rows.groupBy("cause", "effect", key.alias("k")).agg(F.min(F.struct("claim_seq", "v")).alias("f"))
    return once.groupBy("cause", "effect").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["v"]).alias(name))


def merge_mechanisms(claims: DataFrame) -> DataFrame:
    """Mechanisms of each edge: trimmed, placeholders dropped, one of each spelling in any case."""
    value = trim_space(F.col("mechanism"))
    return _texts(claims.filter(~is_placeholder(F.col("mechanism"))), value, F.lower("v"), "mechanisms")


def merge_evidence(claims: DataFrame) -> DataFrame:
    """Evidence sentences of each edge: trimmed, exact repeats dropped."""
    return _texts(claims, trim_space(F.col("evidence")), F.col("v"), "evidence_sentences")


def merge_counts(claims: DataFrame) -> DataFrame:
    """Per (cause, effect) the mean confidence over claims, the number of papers, and edge_key.

    Papers are folded first, then pairs: both steps pre-aggregate before their shuffle. edge_key
    orders edges by confidence, greatest first, then by first claim.
    """
    by_paper = claims.groupBy("cause", "effect", "source_paper").agg(F.sum(F.round(F.col("confidence") * UNIT).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"), F.min("claim_seq").alias("q"))
    pairs = by_paper.groupBy("cause", "effect").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("paper_count"), F.min("q").alias("q"))
    mean = F.expr(f"((2 * s + {UNIT // 10_000} * n) div (2 * {UNIT // 10_000} * n)) / 10000.0D")
    return pairs.select("cause", "effect", mean.alias("avg_confidence"), "paper_count", F.struct((-mean).alias("c"), F.col("q").alias("q")).alias("edge_key"))


def merge_claims(claims: DataFrame) -> DataFrame:
    """Edges of (already normalised) claims."""
    edges = merge_counts(claims)
    for part in (merge_mechanisms(claims), merge_evidence(claims)):
        edges = edges.join(part, ["cause", "effect"], "left")
    none = F.array().cast("array<string>")
    return edges.withColumns({"mechanisms": F.coalesce("mechanisms", none), "evidence_sentences": F.coalesce("evidence_sentences", none)})


def filter_edges(edges: DataFrame, min_confidence: float = 0.5, min_papers: int = 1) -> DataFrame:
    """Edges that reach both thresholds, on the rounded mean."""
    return edges.filter((F.col("avg_confidence") >= min_confidence) & (F.col("paper_count") >= min_papers))
