"""Prompt context of gaps, generated hypotheses, and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapgraph.errors import NoGapsError
from gapgraph.functions.jsonparse import NO_MECHANISM, parse_hypotheses
from gapgraph.functions.scoring import composite_score
from gapgraph.functions.text import arrow, fill, two_digits
from gapgraph.operators.completion import UNUSABLE, CompletionClient, complete
from gapgraph.operators.gaps import edge_roles
from gapgraph.prompts import HYPOTHESIS, HYPOTHESIS_SYSTEM, STRICT
from gapgraph.stages import Stages

#: Edges that a prompt shows.
CONTEXT_EDGES = 12
_GAP = ("variable", "gap_type", "gap_score", "neighboring_nodes", "existing_edges", "gap_explanation")


def first_mechanisms(claims: DataFrame, empty_allowed: bool = False) -> DataFrame:
    """(cause, effect, mechanism): the first said mechanism of each pair of raw names."""
    said = ~F.contains(F.lower("mechanism"), F.lit("not specified"))
    rows = claims.filter(said if empty_allowed else said & (F.col("mechanism") != ""))
    return rows.groupBy("cause", "effect").agg(F.min(F.struct("claim_seq", "mechanism")).alias("f")).select("cause", "effect", F.col("f.mechanism").alias("mechanism"))


def mechanism_lists(claims: DataFrame) -> DataFrame:
    """(cause, effect, mechanisms): the distinct mechanisms said of each pair of raw names, as they first appear."""
    said = claims.filter((F.col("mechanism") != "") & ~F.contains(F.lower("mechanism"), F.lit("not specified")))
    once = said.groupBy("cause", "effect", "mechanism").agg(F.min("claim_seq").alias("q"))
    ordered = F.array_sort(F.collect_list(F.struct("q", "mechanism")))
    return once.groupBy("cause", "effect").agg(F.transform(ordered, lambda x: x["mechanism"]).alias("mechanisms"))


def context_edges(edges: DataFrame, claims: DataFrame, n: int = CONTEXT_EDGES) -> DataFrame:
    """The n strongest edges with rank (from 1) and first mechanism."""
    top = edges.orderBy("edge_key").limit(n)
    ranked = top.select("cause", "effect", "avg_confidence", "paper_count", F.row_number().over(Window.orderBy("edge_key")).alias("rank"))
    return ranked.join(first_mechanisms(claims), ["cause", "effect"], "left").withColumn("mechanism", F.coalesce("mechanism", F.lit(NO_MECHANISM)))


def edge_context(edges: DataFrame, claims: DataFrame, n: int = CONTEXT_EDGES) -> DataFrame:
    """One row: papers and the context text, its n strongest edges and, if there are n, how many more there are."""
    line = F.concat(F.lit("- "), arrow(F.col("cause"), F.col("effect")), F.lit(" (confidence "), two_digits(F.col("avg_confidence")), F.lit(", papers "), F.col("paper_count").cast("string"), F.lit(": "), F.col("mechanism"), F.lit(")"))
    lines = context_edges(edges, claims, n).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    counts = edges.agg(F.count(F.lit(1)).alias("edges"))
    papers = claims.agg(F.count_distinct("source_paper").alias("papers"))
    shown = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    more = F.when(F.size("l") >= n, F.concat(F.lit("\n… and "), (F.col("edges") - n).cast("string"), F.lit(" more"))).otherwise("")
    return lines.crossJoin(counts).crossJoin(papers).select("papers", F.concat(shown, more).alias("context"))


def existing_edges(gaps: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(variable, ord, cause, effect, avg_confidence, mechanism): edges at each gap's variable, causes first, then by strength."""
    variables = gaps.select(F.col("variable").alias("node")).distinct()
    ties = edge_roles(edges).join(variables, "node")
    named = ties.withColumns({"cause": F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("node")), "effect": F.when(F.col("role") == 0, F.col("node")).otherwise(F.col("other"))})
    joined = named.join(first_mechanisms(claims, empty_allowed=True), ["cause", "effect"], "left")
    return joined.select(F.col("node").alias("variable"), F.struct("role", "edge_key").alias("ord"), "cause", "effect", "avg_confidence", F.coalesce("mechanism", F.lit(NO_MECHANISM)).alias("mechanism"))


def _existing_text(gaps: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), arrow(F.col("cause"), F.col("effect")), F.lit(": "), F.col("mechanism"))
    rows = existing_edges(gaps, edges, claims).select("variable", F.struct("ord", line.alias("line")).alias("x"))
    return rows.groupBy("variable").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("existing"))


def _or(c: Column, text: str) -> Column:
    return F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c).otherwise(F.lit(text))


def prompts(gaps: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """gaps as (gap, prompt)."""
    rows = gaps.join(_existing_text(gaps, edges, claims), "variable", "left").crossJoin(F.broadcast(edge_context(edges, claims)))
    text = fill(
        HYPOTHESIS,
        papers=F.col("papers").cast("string"),
        context=F.col("context"),
        variable=F.col("variable"),
        kind=F.col("gap_type"),
        explanation=F.col("gap_explanation"),
        neighbours=_or(F.array_join("neighboring_nodes", ", "), "none identified"),
        existing=_or(F.col("existing"), "none"),
    )
    return rows.select(F.struct(*_GAP).alias("gap"), text.alias("prompt"))


def generate(gaps: DataFrame, edges: DataFrame, claims: DataFrame, client: CompletionClient, max_hypotheses: int = 10, max_retries: int = 3, deterministic_ids: bool = False, accept_array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, failures) for the best ``max_hypotheses`` gaps: one call each, one strict retry, answers written before they are parsed."""
    if gaps.isEmpty():
        raise NoGapsError("the graph has no gaps")
    stages = Stages(gaps.sparkSession, "hypotheses")
    asked = stages.write(prompts(gaps.orderBy("gap_key").limit(max_hypotheses), edges, claims), "prompts")
    first = stages.write(complete(asked, client, HYPOTHESIS_SYSTEM, 0.4, 1024, max_retries), "first")
    good, bad = parse_hypotheses(first.filter("status = 'ok'").select("gap", "prompt", "raw"), deterministic_ids, accept_array)
    again = bad.select("gap", F.concat("prompt", F.lit(STRICT)).alias("prompt"))
    second = stages.write(complete(again, client, HYPOTHESIS_SYSTEM, 0.0, 1024, max_retries), "second")
    more, failed = parse_hypotheses(second.filter("status = 'ok'").select("gap", "prompt", "raw"), deterministic_ids, accept_array)
    lost = first.unionByName(second).filter("status <> 'ok'").select("gap", F.col("status").alias("error"))
    return stages.write(good.unionByName(more).drop("prompt"), "hypotheses"), lost.unionByName(failed.select("gap", F.lit(UNUSABLE).alias("error")))


def rank(hypotheses: DataFrame, order: str = "id") -> DataFrame:
    """Hypotheses with composite_score and rank from 1; equal scores by ``order``.

    Their number is what a run asks for (100 at most), so one task ranks them.
    """
    scored = hypotheses.withColumn("composite_score", composite_score(F.col("testability_score"), F.col("novelty_score"), F.col("gap_addressed.gap_score")))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite_score"), order)))
