"""Shared helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gapgraph.stages import Stages, shared_dir

__all__ = ["GAPS", "Stages", "compact", "input_bytes", "part_count", "release", "shared_dir", "slices", "table"]

#: Separators of words, the space and the ASCII controls 9 to 13, for Java's regular expressions.
GAPS = r"[\x20\x09-\x0D]+"
#: Rows that a Python function turns into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: Bytes of input under which partitions are put together, and the partitions that are left at least.
PART_BYTES = 4 << 20
MIN_PARTS = 12
#: The planner gives what it knows nothing of a size beyond any input.
UNKNOWN_BYTES = 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """The planner's size of what a table reads (from file sizes, no job); None if it is unknown (an RDD)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < UNKNOWN_BYTES else None


def part_count(df: DataFrame) -> int | None:
    """Partitions of PART_BYTES of a table's input; None if its size is unknown."""
    size = input_bytes(df)
    return None if size is None else max(MIN_PARTS, size // PART_BYTES)


def compact(df: DataFrame) -> DataFrame:
    """The table in no more partitions than its input is worth: each file that a task writes costs a machine's time."""
    parts = part_count(df)
    return df if parts is None else df.coalesce(parts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches in short slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def release() -> None:
    """Gives a Python worker's free memory back to the system; workers live on between tasks and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass
