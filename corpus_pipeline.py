"""The corpus pipeline: quality rules, line dedup, n-gram join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

In every stage a null text is an empty one (quality rules and line dedup drop or keep it by their
operators' docstrings), a null id stands behind all others, repeated rows are documents of their own,
an empty table gives no rows, and other columns are carried along under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapgraph.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from gapgraph.llm.common import Stages, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail a rule or are depleted."""
    return _measured(quality_rules.clean_documents(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents of which nothing is left go."""
    return _measured(line_dedup.drop_repeated_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return ngram_join.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return _measured(decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed: one row per piece."""
    return packing.pack_documents(docs, **packing.public_byte_bpe())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near), ("decontamination", leaks), ("packing", pack)]

#: The fuzzy stages and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of a folder."""
    written = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            written.drop(f"stage{k - 1}")
    return docs
