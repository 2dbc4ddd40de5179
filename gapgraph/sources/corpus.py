"""Sources of papers: text files, lists of texts and tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gapgraph.errors import CorpusError
from gapgraph.functions.text import trim_space
from gapgraph.schemas import PAPERS

logger = logging.getLogger(__name__)
#: Files left out of a corpus that are named in warnings.
SHOWN_FAULTS = 100


def _status(spark: SparkSession, path: str):
    """The file status of a path in whatever store it names, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(where) if fs.exists(where) else None


def _papers(spark: SparkSession, paths: str | list[str], strict: bool, **options) -> DataFrame:
    """Papers of text files, ordered by path. A file that is blank or no UTF-8 is an error if ``strict``, else left out with a warning.

    Only paths are ranked in one task, and the driver lists all of them anyway.
    """
    reader = spark.read.format("binaryFile").options(**options)
    files = reader.load(paths).select(F.col("path").alias("_path"), F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1).alias("source_paper"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
    texts = files.withColumn("content", trim_space(F.col("value"))).drop("value")
    bad = texts.filter(F.col("content").isNull() | (F.length("content") == 0)).select("_path", F.col("content").isNull().alias("coded")).limit(SHOWN_FAULTS).collect()
    for row in bad:
        reason = "it is no UTF-8 text" if row.coded else "nothing but white space in it"
        if strict:
            raise CorpusError(row["_path"], reason)
        logger.warning("%s left out: %s", row["_path"], reason)
    texts = texts.filter(F.length("content") > 0)
    order = texts.select("_path").withColumn("paper_ord", F.row_number().over(Window.orderBy("_path")).cast("long") - 1)
    return texts.join(order, "_path").select("paper_ord", "source_paper", "content")


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """The *.txt files of a folder (not of its subfolders) as papers, by path."""
    status = _status(spark, path)
    if status is None:
        raise CorpusError(path, "it does not exist")
    if not status.isDirectory():
        raise CorpusError(path, "it is not a directory")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    if not any(s.isFile() and s.getPath().getName().endswith(".txt") for s in listed):
        raise CorpusError(path, "it holds no .txt files")
    papers = _papers(spark, path, strict=False, pathGlobFilter="*.txt")
    if papers.isEmpty():
        raise CorpusError(path, "all of its files are empty")
    return papers


def load_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The given files as papers; each must be there and hold text."""
    for path in paths:
        status = _status(spark, path)
        if status is None:
            raise CorpusError(path, "it does not exist")
        if not status.isFile():
            raise CorpusError(path, "it is not a file")
    return _papers(spark, list(paths), strict=True)


def load_any(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One folder, or any number of files."""
    if len(paths) == 1 and (status := _status(spark, paths[0])) is not None and status.isDirectory():
        return load_directory(spark, paths[0])
    return load_files(spark, paths)


def from_texts(spark: SparkSession, texts: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Texts in memory as papers, named paper_1, paper_2, ... unless names are given."""
    if names is not None and len(names) != len(texts):
        raise ValueError(f"{len(texts)} texts but {len(names)} names")
    rows = [(i, names[i] if names is not None else f"paper_{i + 1}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAPERS)


def from_table(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of texts as papers; the id gives order and name."""
    return table.select(F.col(id_col).cast("long").alias("paper_ord"), F.concat(F.lit("doc_"), F.col(id_col).cast("string")).alias("source_paper"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
