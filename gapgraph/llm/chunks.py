"""Texts in chunks, and questions that chunks put to hash buckets.

Operators that look for equal hashes across all documents work on chunks: rows of some megabytes
that hold many whole texts. A chunk hashes its texts at once, drops repeats of its own, and sends
each hash bucket one packed array; a bucket answers each chunk with an array of the same order.
A hash that is everywhere is thus one entry from each chunk, and shuffles carry bytes, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.common import compact, input_bytes, release

#: Bytes of a chunk's texts; a longer text is a chunk of its own. With more than 16,384 buckets chunks grow
#: by CHARS_PER_BUCKET for each, so that a chunk has about 20 words for every bucket it writes to.
CHUNK_CHARS, MAX_CHUNK_CHARS = 2 << 20, 64 << 20
CHARS_PER_BUCKET = 128
#: Chunks are shuffled once or more; a level above the lowest is worth its time.
ZSTD_LEVEL = 4
#: Bytes of input for each hash bucket, which a bucket's memory follows.
BUCKET_BYTES = 64 << 20
MIN_BUCKETS, MAX_BUCKETS = 64, 1 << 20
#: Bytes of input for each task of what is computed by bucket or chunk.
WORK_BYTES = 16 << 20
#: Buckets, and tasks, for an input of unknown size.
UNKNOWN_BUCKETS = 1 << 10

Parts = Iterator[tuple[int, bytes]]


def bucket_count(docs: DataFrame) -> int:
    """A power of two by the size of the input; one of unknown size gets UNKNOWN_BUCKETS."""
    size = input_bytes(docs)
    wanted = UNKNOWN_BUCKETS if size is None else size // BUCKET_BYTES
    return 1 << (min(MAX_BUCKETS, max(MIN_BUCKETS, wanted)) - 1).bit_length()


def chunk_size(buckets: int) -> int:
    """Bytes of a chunk's texts where hashes go to so many buckets."""
    return min(MAX_CHUNK_CHARS, max(CHUNK_CHARS, CHARS_PER_BUCKET * buckets))


def work_parts(docs: DataFrame) -> int:
    """Tasks, and so files, of tables that grow with the input; those of ids alone take light_parts."""
    size = input_bytes(docs)
    return UNKNOWN_BUCKETS if size is None else max(12, size // WORK_BYTES)


def light_parts(buckets: int) -> int:
    return max(3, buckets // 16)


def make_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int | None = None, others: list[str] | None = None) -> DataFrame:
    """(chunk, content): each content is a compressed Arrow table (doc_id, text, x0, x1, ...) with the ``others`` columns last.

    Without ``chunk_chars`` the size of chunks follows that of the input.
    """
    most = chunk_chars or chunk_size(bucket_count(docs))
    more = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(others or [])]
    rows = compact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more))

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        held = 0

        def row():
            sink = pa.BufferOutputStream()
            content = pa.Table.from_batches(parts).combine_chunks()
            with pa.ipc.new_stream(sink, content.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))) as writer:
                writer.write_table(content)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "content"])

        for batch in batches:
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
            start = 0
            for i, n in enumerate(sizes):
                if held and held + n > most:
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    yield row()
                    parts, held, start, chunk = [], 0, i, chunk + 1
                held += n
            if start < len(sizes):
                parts.append(batch.slice(start))
        if parts:
            yield row()
        parts = []
        release()

    return rows.mapInArrow(run, "chunk long, content binary")


def open_chunk(content: bytes) -> tuple[list, list[bytes]]:
    """(ids, UTF-8 texts) of a chunk; a null text is empty."""
    table = pa.ipc.open_stream(content).read_all()
    return table.column(0).to_pylist(), [t or b"" for t in table.column(1).cast(pa.binary()).to_pylist()]


def with_replies(chunks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Chunks joined with the answers they got: a column a0, a1, ... of array<struct<bucket, reply>> for each question.

    Always a shuffle by chunk: answers grow with the input, so they are never broadcast.
    """
    for i, reply in enumerate(replies):
        by_chunk = reply.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(f"a{i}"))
        chunks = chunks.join(by_chunk.hint("merge"), "chunk", "left")
    return chunks


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[bytes], list[dict[int, bytes]]]]:
    for i in range(batch.num_rows):
        chunk, content, *answers = (c[i].as_py() for c in batch.columns)
        yield chunk, *open_chunk(content), [{x["bucket"]: x["reply"] for x in a or ()} for a in answers]


def ask(chunks: DataFrame, question: Callable[[list, list[bytes], list[dict[int, bytes]]], Parts], answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, bucket, reply): each chunk's question, answered by each bucket from what all chunks sent it.

    ``question`` gives (bucket, packed bytes) for a chunk's ids, texts and former answers; ``answer``
    gets the packed bytes of all chunks for one bucket and gives as many replies.
    """

    def send(batches):
        for batch in batches:
            for chunk, ids, texts, answers in _rows(batch):
                parts = [(chunk, b, p) for b, p in question(ids, texts, answers)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "part"])
                parts = ids = texts = answers = None
        release()

    def reply(table: pa.Table) -> pa.Table:
        replies = answer(table.column("part").to_pylist())
        release()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary())})

    sent = chunks.mapInArrow(send, "chunk long, bucket int, part binary")
    return sent.groupBy("bucket").applyInArrow(reply, "chunk long, bucket int, reply binary")


def each_chunk(chunks: DataFrame, rows: Callable[[list, list[bytes], list[dict[int, bytes]]], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows that ``rows`` makes of each chunk; a first column of the schema named chunk is added here."""
    numbered = schema.startswith("chunk long")

    def run(batches):
        for batch in batches:
            for chunk, ids, texts, answers in _rows(batch):
                made = rows(ids, texts, answers)
                if numbered:
                    made = pa.RecordBatch.from_arrays([pa.array(np.full(made.num_rows, chunk)), *made.columns], names=["chunk", *made.schema.names])
                yield made
                made = ids = texts = answers = None
        release()

    return chunks.mapInArrow(run, schema)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bucket numbers of runs in a sorted hash array that fall into one bucket (by the highest bits)."""
    of = (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return np.append(cuts, len(of)), of[cuts]


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Group number of each item of a sorted array."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([[False], sorted_values[1:] != sorted_values[:-1]]))
