"""Fuzzy line dedup: one line stays of each group of lines with similar character shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.chunks import ask, bucket_count, by_bucket, each_chunk, groups_of, light_parts, make_chunks, with_replies, work_parts
from gapgraph.llm.common import Stages, release
from gapgraph.llm.hashing import U, grams, minhash, mix
from gapgraph.llm.near import WORK_TABLES, components, link_groups

#: Characters of a shingle; a shorter line is one shingle of its own.
SHINGLE_CHARS = 8
THRESHOLD = 0.8
#: Bands and MinHash values of each: a pair at the threshold meets with probability 1 - (1 - 0.8^4)^12 = 0.998.
BANDS = 12
BAND_ROWS = 4
SEED = 20240301

_NODES = "chunk long, row int, line int, doc_id long, item binary, content binary, marks binary, groups array<long>"


#: Every byte as it is, but ASCII white space within a line as a space.
_BLANKS = bytes(0x20 if b in (0x09, 0x0B, 0x0C, 0x0D) else b for b in range(256))


def normal_lines(text: bytes) -> list[bytes]:
    """The lines of a text, each with single spaces for runs of ASCII white space and none at its ends."""
    text = text.translate(_BLANKS)
    if b"  " in text:
        return [b" ".join(line.split()) for line in text.split(b"\n")]
    return [line.strip(b" ") for line in text.split(b"\n")]


def _characters(line: bytes, k: int) -> str:
    """A line of k characters at least: a shorter one is filled up with line ends, which no line has."""
    return line.decode("utf-8", "replace").ljust(k, "\n")


def shingles(lines: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's runs of k characters; a shorter line has one of its own."""
    texts = [_characters(x, k) for x in lines]
    every = grams(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), k)
    ends = np.cumsum([len(t) for t in texts])
    return [np.unique(every[end - len(t) : end - k + 1]) for end, t in zip(ends.tolist(), texts, strict=True)]


class _Lines:
    def __init__(self, k: int, bands: int, rows: int, buckets: int):
        self.k, self.bands, self.rows, self.buckets = k, bands, rows, buckets
        rng = np.random.default_rng(SEED)
        self.multipliers = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)

    def distinct(self, texts) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The chunk's distinct lines; and of each line text, number, and which distinct line it is."""
        found: dict[bytes, int] = {}
        row, line, which = [], [], []
        for i, text in enumerate(texts):
            for j, norm in enumerate(normal_lines(text)):
                if norm:
                    row.append(i)
                    line.append(j)
                    which.append(found.setdefault(norm, len(found)))
        return list(found), (np.array(row, np.int32), np.array(line, np.int32), np.array(which, np.int64))

    def band_keys(self, lines: list[bytes]) -> np.ndarray:
        """(lines, bands) keys, the band's number mixed in."""
        texts = [_characters(x, self.k) for x in lines]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        every = grams(codes, self.k, np.uint32)
        ends = np.cumsum(sizes)
        inside = np.ones(len(every), bool)
        for back in range(1, self.k):  # runs across two lines
            at = ends[:-1] - back
            inside[at[(at >= 0) & (at < len(every))]] = False
        starts = np.concatenate([[0], np.cumsum(sizes - self.k + 1)])[:-1]
        values = minhash(every[inside], starts, self.multipliers).astype(U)
        keys = np.zeros((len(lines), self.bands), U)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                key = np.full(len(lines), b + 1, U)
                for r in range(self.rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + values[:, b * self.rows + r])
                keys[:, b] = key
        return keys

    @staticmethod
    def names(lines: list[bytes]) -> list[bytes]:
        return [hashlib.blake2b(x, digest_size=16).digest() for x in lines]

    # which bands do two different lines share, and which lines are in two chunks

    def _packed(self, names: list[bytes], keys: np.ndarray):
        """Distinct sorted keys with a check of the line that has them, and whether two lines of the chunk do."""
        check = np.array([int.from_bytes(x[:8], "little") for x in names], U)
        flat, owner = keys.reshape(-1), np.repeat(check, self.bands)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        group = groups_of(flat)
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        return flat[first], owner[first], several

    def ask_bands(self, ids, texts, answers):
        lines, _ = self.distinct(texts)
        if not lines:
            return
        names = self.names(lines)
        key, owner, several = self._packed(names, self.band_keys(lines))
        shift = U(self.buckets.bit_length() - 1)
        cuts, numbers = by_bucket(key, self.buckets)
        for a, b, number in zip(cuts[:-1], cuts[1:], numbers, strict=True):
            # 40 bits of the key below the bucket's, and 24 of the line's check
            packed = (((key[a:b] << shift) >> U(24)) << U(24)) | (owner[a:b] >> U(40))
            yield int(number), b"B" + np.packbits(several[a:b]).tobytes() + packed.tobytes()
        exact = np.sort(np.array([int.from_bytes(x[:8], "big") for x in names], U))
        cuts, numbers = by_bucket(exact, self.buckets)
        for a, b, number in zip(cuts[:-1], cuts[1:], numbers, strict=True):
            yield int(number) + self.buckets, b"E" + exact[a:b].tobytes()

    @staticmethod
    def answer_bands(parts):
        if parts[0][:1] == b"E":
            values = [np.frombuffer(p, U, offset=1) for p in parts]
            every = np.concatenate(values)
            order = np.argsort(every, kind="stable")
            group = groups_of(every[order])
            many = np.zeros(len(every), bool)
            many[order] = (np.bincount(group) > 1)[group]
        else:
            values, flags = [], []
            for p in parts:
                n = (8 * (len(p) - 1)) // 65
                n = next(x for x in (n - 1, n, n + 1) if x >= 0 and (x + 7) // 8 + 8 * x == len(p) - 1)
                head = (n + 7) // 8
                flags.append(np.unpackbits(np.frombuffer(p, np.uint8, head, 1), count=n))
                values.append(np.frombuffer(p[1 + head :], U))
            every, flag = np.concatenate(values), np.concatenate(flags)
            order = np.argsort(every, kind="stable")
            every, flag = every[order], flag[order]
            group = groups_of(every >> U(24))
            first = np.searchsorted(group, np.arange(group[-1] + 1))
            check = every & U((1 << 24) - 1)
            several = (np.minimum.reduceat(check, first) != np.maximum.reduceat(check, first)) | (np.maximum.reduceat(flag, first) > 0)
            many = np.zeros(len(every), bool)
            many[order] = several[group]
        return [np.packbits(x).tobytes() for x in np.split(many, np.cumsum([len(v) for v in values])[:-1])]

    def _bits(self, distinct: np.ndarray, answers: dict[int, bytes], base: int) -> np.ndarray:
        cuts, numbers = by_bucket(distinct, self.buckets)
        parts = [np.unpackbits(np.frombuffer(answers[int(b) + base], np.uint8), count=e - a) for a, e, b in zip(cuts[:-1], cuts[1:], numbers, strict=True)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)

    def nodes(self, ids, texts, answers):
        """A row per line; item names the line if another resembles it or it is there again, else it is null.

        The first row of such a line in a chunk carries what comparing it needs.
        """
        lines, (row, line, which) = self.distinct(texts)
        n = len(lines)
        item = pa.nulls(len(row), pa.binary())
        content, marks, groups = ([None] * len(row) for _ in range(3))
        if n:
            names = self.names(lines)
            keys = self.band_keys(lines)
            distinct = np.unique(keys)
            shared = self._bits(distinct, answers[0], 0)[np.searchsorted(distinct, keys)]
            number = np.array([int.from_bytes(x[:8], "big") for x in names], U)
            exact = np.sort(number)
            again = self._bits(exact, answers[0], self.buckets)[np.searchsorted(exact, number)]
            flagged = shared.any(1) | again | (np.bincount(which, minlength=n) > 1)
            item = pa.array(names, pa.binary()).take(pa.array(np.where(flagged[which], which, -1), mask=~flagged[which]))
            first = np.unique(which, return_index=True)[1]
            for k in np.flatnonzero(shared.any(1)):
                at, own = first[k], keys[k].view(np.int64)
                content[at], marks[at], groups[at] = lines[k], own.tobytes(), np.unique(own[shared[k]]).tolist()
        doc = pa.array(ids, pa.int64()).take(pa.array(row, pa.int64()))
        columns = [pa.array(row), pa.array(line), doc, item, pa.array(content, pa.binary()), pa.array(marks, pa.binary()), pa.array(groups, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["row", "line", "doc_id", "item", "content", "marks", "groups"])


def _decisions(docs: DataFrame, id_col: str, text_col: str, others, threshold: float, shingle: int, bands: int, rows: int, chunk_chars: int | None):
    """(lines, chunks, nodes, kept): nodes have a row per line, kept (item, place) the line that stays for each named item."""
    stages = Stages(docs.sparkSession, "line-dedup")
    lines = _Lines(shingle, bands, rows, bucket_count(docs))
    some, few = work_parts(docs), light_parts(lines.buckets)
    chunks = stages.write(make_chunks(docs, id_col, text_col, chunk_chars, others), "chunks")
    found = stages.write(ask(chunks, lines.ask_bands, lines.answer_bands), "bands", some)
    nodes = stages.write(each_chunk(with_replies(chunks, found), lines.nodes, _NODES), "nodes", some)
    full = nodes.filter("content is not null").groupBy("item").agg(F.first("content").alias("content"), F.first("marks").alias("marks"), F.first("groups").alias("groups"))
    items = stages.write(full.withColumn("weight", F.lit(1).cast("long")), "items", some)
    k = lines.k
    links = stages.write(link_groups(items.select(F.explode("groups").alias("group"), "item"), items, threshold, lambda some: shingles(some, k), stages, 4 * lines.buckets), "links", some)
    stages.drop(*WORK_TABLES)
    labels = components(stages, links, few)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "chunk", "row", "line")
    first = nodes.filter("item is not null").groupBy("item").agg(F.min(place).alias("place"))
    labelled = stages.write(first.join(labels, "item", "left").select("item", F.coalesce("label", "item").alias("label"), "place"), "labelled", some)
    best = stages.write(labelled.groupBy("label").agg(F.min("place").alias("place")), "best", some)
    return lines, chunks, nodes, stages.write(labelled.select("item", "label").join(best, "label").select("item", "place"), "kept", some)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE_CHARS, bands: int = BANDS, rows: int = BAND_ROWS, chunk_chars: int | None = None) -> DataFrame:
    """doc_id, line_no, class_doc, class_line, kept of every line that is not blank.

    Lines (split at \\n, runs of white space made one space) are linked if the Jaccard similarity of
    their character shingles is ``threshold`` or more; of each connected component the line of the
    smallest id stays, then the first. class_doc and class_line name it.

    Chunks drop their own repeats and ask hash buckets which bands two different lines share and which
    lines other chunks have too. Only those lines travel: pairs of a band are compared exactly, block by
    block, and components come from distributed union-find. Line numbers count from 0.

    A null text has no lines; a null id stands behind all others; repeated rows are documents of their
    own; an empty table gives no rows; other columns are not read.
    """
    lines, _, nodes, kept = _decisions(docs, id_col, text_col, None, threshold, shingle, bands, rows, chunk_chars)
    alone = nodes.filter("item is null").select("doc_id", F.col("line").alias("line_no"), F.col("doc_id").alias("class_doc"), F.col("line").alias("class_line"), F.lit(True).alias("kept"))
    named = nodes.filter("item is not null").select("chunk", "row", "line", "doc_id", "item").join(kept, "item")
    stays = (F.col("chunk") == F.col("place.chunk")) & (F.col("row") == F.col("place.row")) & (F.col("line") == F.col("place.line"))
    named = named.select("doc_id", F.col("line").alias("line_no"), F.col("place.doc_id").alias("class_doc"), F.col("place.line").alias("class_line"), stays.alias("kept"))
    return alone.unionByName(named.coalesce(work_parts(docs)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE_CHARS, bands: int = BANDS, rows: int = BAND_ROWS, chunk_chars: int | None = None) -> DataFrame:
    """``docs`` with all columns, each component's lines but one taken out of the texts.

    A document that lost lines and has no word left goes; others, null texts included, stay. Repeated
    rows are documents of their own, so the first keeps its lines; a null id stands behind all others; an
    empty table gives no rows; other columns may have any name.
    """
    others = [c for c in docs.columns if c != text_col]
    lines, chunks, nodes, kept = _decisions(docs, id_col, text_col, others, threshold, shingle, bands, rows, chunk_chars)
    schema, where = docs.schema, docs.columns.index(text_col)
    place = F.col("place")
    goes = ~((F.col("chunk") == place["chunk"]) & (F.col("row") == place["row"]) & (F.col("line") == place["line"]))
    gone = nodes.filter("item is not null").select("chunk", "row", "line", "item").join(kept, "item").filter(goes).select("chunk", "row", "line")
    by_chunk = gone.groupBy("chunk").agg(F.collect_list(F.struct("row", "line")).alias("gone"))

    def run(batches):
        for batch in batches:
            for content, gone_ in zip(batch.column("content"), batch.column("gone"), strict=True):
                table, gone = pa.ipc.open_stream(content.as_py()).read_all(), {}
                for x in gone_.as_py() or ():
                    gone.setdefault(x["row"], set()).add(x["line"])
                column, stay = table.column(1).to_pylist(), [True] * table.num_rows
                for i, some in gone.items():
                    left = "\n".join(x for j, x in enumerate(column[i].split("\n")) if j not in some)
                    column[i], stay[i] = left, bool(left.strip(" \t\n\v\f\r"))
                columns = table.columns[2:]
                columns.insert(where, pa.array(column, pa.string()))
                yield from pa.table(columns, names=schema.names).filter(pa.array(stay)).to_batches()
        release()

    return chunks.join(by_chunk.hint("merge"), "chunk", "left").select("content", "gone").mapInArrow(run, schema).coalesce(work_parts(docs))
