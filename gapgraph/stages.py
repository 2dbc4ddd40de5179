"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or a temporary folder where that is unset and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gapgraph-")
        spark.sparkContext.setCheckpointDir(where)
    return where


class Stages:
    """Intermediate tables of one query, written as Parquet under the shared folder.

    A written table cuts lineage: a lost executor costs the tasks in flight, not the
    stages before. Tables go when the JVM ends; ``drop`` removes those that are used up.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self, where: str):
        return self._path(where).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """The table, written and read again; ``parts`` bounds its files, for tables that are small beside their shuffle."""
        where = f"{self.root}/{name}"
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs(self.root).delete(self._path(f"{self.root}/{name}"), True)
