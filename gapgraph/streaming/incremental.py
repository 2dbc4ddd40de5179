"""Incremental corpora: new text files become claims as they arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapgraph.functions.text import trim_space
from gapgraph.operators.claims import extract_claims
from gapgraph.operators.completion import CompletionClient
from gapgraph.operators.graph import KnowledgeGraph, build_graph


def stream_papers(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of papers: each new .txt file of a folder is one; its path's hash is its order."""
    files = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.txt").schema("value string").text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_paper"), trim_space(F.col("value")).alias("content"))
    return named.filter(F.length("content") > 0).select(F.xxhash64("path").alias("paper_ord"), "source_paper", "content")


def stream_claims(papers: DataFrame, client: CompletionClient, claims_path: str, checkpoint: str, max_retries: int = 3):
    """Starts a query that appends each batch's claims, one folder a batch, so a repeated batch replaces its own."""

    def append(batch: DataFrame, number: int) -> None:
        claims, _ = extract_claims(batch, client, max_retries)
        claims.write.mode("overwrite").parquet(f"{claims_path}/batch={number}")

    return papers.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_graph(spark: SparkSession, claims_path: str, min_confidence: float = 0.5, min_papers: int = 1) -> KnowledgeGraph:
    """The graph of all claims so far."""
    return build_graph(spark.read.parquet(claims_path).drop("batch"), min_confidence, min_papers)
