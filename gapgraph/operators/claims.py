"""Claims: extraction from paragraphs by a completion client, and dedup within a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapgraph.functions.jsonparse import parse_claims
from gapgraph.functions.text import MAX_PARAGRAPH, MIN_PARAGRAPH, fill, split_papers
from gapgraph.operators.completion import CompletionClient, complete
from gapgraph.prompts import EXTRACT, EXTRACT_SYSTEM, STRICT
from gapgraph.stages import Stages


def dedup_within_paper(claims: DataFrame) -> DataFrame:
    """Per (paper, cause, effect) the claim of greatest confidence, the first of equals, at the place of the first.

    claims need paper_ord, chunk_ord and claim_ord; the result has claim_seq instead, a struct that
    orders claims as their papers and first appearances do.
    """
    place = F.struct("paper_ord", "chunk_ord", "claim_ord")
    best = F.struct((-F.col("confidence")).alias("_c"), "chunk_ord", "claim_ord", "confidence", "mechanism", "source_paper", "evidence")
    found = claims.groupBy("paper_ord", "cause", "effect").agg(F.min(place).alias("claim_seq"), F.min(best).alias("b"))
    return found.select("claim_seq", "cause", "effect", "b.confidence", "b.mechanism", "b.source_paper", "b.evidence")


def extract_claims(papers: DataFrame, client: CompletionClient, max_retries: int = 3, min_paragraph: int = MIN_PARAGRAPH, max_paragraph: int = MAX_PARAGRAPH, claim_min_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, completions) of papers.

    Each paragraph is one call; answers without usable JSON get one strict retry, and what fails again
    gives no claims. Answers are written before they are parsed, so no retry of a task repeats a
    call that was answered.
    """
    stages = Stages(papers.sparkSession, "extract")
    asked = split_papers(papers, min_paragraph, max_paragraph)
    prompts = asked.withColumn("prompt", fill(EXTRACT, paragraph=F.col("paragraph")))
    first = stages.write(complete(prompts, client, EXTRACT_SYSTEM, 0.1, max_retries=max_retries).withColumn("attempt", F.lit(1)), "first")
    claims, failed = parse_claims(first.filter("status = 'ok'"))
    again = failed.select(*prompts.columns).withColumn("prompt", F.concat("prompt", F.lit(STRICT)))
    second = stages.write(complete(again, client, EXTRACT_SYSTEM, 0.0, max_retries=max_retries).withColumn("attempt", F.lit(2)), "second")
    more, _ = parse_claims(second.filter("status = 'ok'"))
    every = claims.unionByName(more)
    if claim_min_confidence is not None:
        every = every.filter(F.col("confidence") >= claim_min_confidence)
    completions = first.unionByName(second).select("paper_ord", "source_paper", "chunk_ord", "attempt", "raw", "status")
    return dedup_within_paper(every), completions
