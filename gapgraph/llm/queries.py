"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapgraph.llm import decontaminate, html_extract, line_dedup, ngram_join, packing, quality_rules, secret_scan, sharding, substring_dedup, warc
from gapgraph.llm.common import Stages, table
from gapgraph.llm.oracles import ORACLES  # noqa: F401  read by __spark_entry__


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **packing.public_byte_bpe())


def op2_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave_shards(table(spark, sf_dir, "documents"))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "warc")
    archives = f"{stages.root}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    return warc.resolve(stages.write(warc.read_archives(spark, archives, with_payload=False), "records"))


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_hierarchical_packing, op2_de_bruijn_dedup, op3_line_frequency_rules, op4_lsh_forest_join, op5_trigram_secret_scan, op6_fuzzy_line_dedup, op7_stratified_shards, op8_wrapper_induction, op9_warc_salvage, op10_pigeonhole_decontamination)}
