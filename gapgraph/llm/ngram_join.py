"""Near-duplicate documents by n-gram Jaccard similarity, with a MinHash LSH forest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.chunks import ask, bucket_count, by_bucket, each_chunk, groups_of, light_parts, make_chunks, with_replies, work_parts
from gapgraph.llm.common import Stages, release, slices
from gapgraph.llm.hashing import U, Powers, Words, minhash, mix, windows
from gapgraph.llm.near import WORK_TABLES, components, link_groups

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Prefix trees of the forest, the labels of a signature in each, and the recall wanted.
TREES = 24
LABELS = 8
TARGET_RECALL = 0.9999
SEED = 20240229
#: Bytes of a label in a sorted path, and the unit in which expected misses are summed (whole numbers, so order doesn't matter).
LABEL_BYTES = 2
MISS_UNIT = 1_000_000

_NODES = "chunk long, row int, doc_id long, item binary, content binary, marks binary, trees int"
_TRIE = "border boolean, tree int, path binary, item binary, left int, right int, keys array<long>"


def recall_at(depth: int, similarity, trees: int):
    """The probability that a pair has a common prefix of ``depth`` labels in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def floor_depth(threshold: float, trees: int, labels: int, target: float) -> int:
    """The longest prefix at which any pair at the threshold is met with probability ``target``; no prefix need be shorter."""
    depth = labels
    while depth > 1 and recall_at(depth, threshold, trees) < target:
        depth -= 1
    return depth


class _Forest:
    #: Tasks of the tables that grow with the input.
    parts = 12

    def __init__(self, shingle: int, trees: int, labels: int, floor: int, buckets: int):
        if trees > 31:
            raise ValueError("a forest has 31 trees at most")
        self.shingle, self.trees, self.labels, self.floor, self.buckets = shingle, trees, labels, floor, buckets
        self.powers = Powers()
        rng = np.random.default_rng(SEED)
        self.multipliers = rng.integers(0, 1 << 31, (trees, labels), np.uint32) * np.uint32(2) + np.uint32(1)

    def split(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
        """The sorted distinct shingle hashes of each text, and the digest that names the set."""
        words = Words(texts, self.powers)
        hashes = windows(words.hash, self.shingle)
        n = len(hashes)
        inside = words.text[:n] == words.text[self.shingle - 1 : self.shingle - 1 + n]
        hashes, text = hashes[inside], words.text[:n][inside]
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        sets, names = [], []
        for i in range(len(texts)):
            a, b = words.first_word[i], words.first_word[i + 1]
            if cut[i + 1] > cut[i]:
                own = np.unique(hashes[cut[i] : cut[i + 1]])
            elif b > a:  # fewer words than a shingle has: all of them are one
                own = windows(words.hash[a:b], int(b - a))
            else:
                own = np.zeros(0, U)
            sets.append(own)
            names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        return sets, names

    def sets(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
        """The set's name of each text; and of the texts that start a new non-empty set here: prefixes (n, trees), number, shingles."""
        sets, names = self.split(texts)
        first: dict[bytes, int] = {}
        for i, name in enumerate(names):
            if len(sets[i]):
                first.setdefault(name, i)
        new = list(first.values())
        shingles = [sets[i] for i in new]
        return names, self.keys(self.signatures(shingles, self.floor))[:, :, -1], np.array(new, np.int64), shingles

    def signatures(self, shingles: list[np.ndarray], labels: int) -> np.ndarray:
        """(n, trees, labels) of the first labels: 16 bits of each MinHash value."""
        if not shingles:
            return np.zeros((0, self.trees, labels), np.uint16)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in shingles])])[:-1]
        least = minhash(np.concatenate(shingles), starts, self.multipliers[:, :labels].reshape(-1))
        with np.errstate(over="ignore"):
            return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16).reshape(len(shingles), self.trees, labels)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(n, trees, depths) of 64-bit names of the prefixes of each length, the tree's number mixed in."""
        out = np.zeros(signatures.shape, U)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, self.trees + 1, dtype=U), signatures.shape[:2])
            for d in range(signatures.shape[2]):
                key = mix(key * U(0x9E3779B97F4A7C15) + signatures[:, :, d])
                out[:, :, d] = key
        return out

    def unpack(self, marks: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(marks), ">u2").astype(np.uint16).reshape(len(marks), self.trees, self.labels)

    def at_depth(self, depth: int):
        """The names of an item's prefixes of ``depth`` labels, one for each tree, from its packed signature."""
        return lambda marks: self.keys(self.unpack(marks)[:, :, :depth])[:, :, -1].view(np.int64)

    def misses(self, similarity: np.ndarray) -> np.ndarray:
        """For each depth from the floor on, the pairs missed for each pair found like these, summed, in MISS_UNITs."""
        depths = range(self.floor, self.labels + 1)
        return np.array([np.rint(MISS_UNIT * (1 / recall_at(d, similarity, self.trees) - 1)).sum() for d in depths]).astype(np.int64)

    def shingles(self, contents: list[bytes]) -> list[np.ndarray]:
        """The shingle sets of compressed texts."""
        return self.split([unpack_text(c) for c in contents])[0]

    def prefixes(self, ids, texts, answers):
        """Each distinct prefix of the least length in a chunk, with the least and greatest set that has it."""
        names, prefix, new, _ = self.sets(texts)
        if not len(new):
            return
        of = np.array([int.from_bytes(names[i][:8], "little") for i in new], U)
        flat, owner = prefix.reshape(-1), np.repeat(of, self.trees)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        group = groups_of(flat)
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        flat = flat[first]
        cuts, numbers = by_bucket(flat, self.buckets)
        for a, b, number in zip(cuts[:-1], cuts[1:], numbers, strict=True):
            yield int(number), np.stack([flat[a:b], low[a:b], high[a:b]]).tobytes()

    @staticmethod
    def answer_prefixes(parts):
        columns = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in parts]
        key, low, high = np.concatenate(columns, axis=1)
        order = np.argsort(key, kind="stable")
        group = groups_of(key[order])
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        several = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
        out = np.zeros(len(key), np.uint8)
        out[order] = several[group]
        return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum([c.shape[1] for c in columns])[:-1])]

    def nodes(self, ids, texts, answers):
        """A row per document; the first of each set that shares a prefix carries its text, its signature and the trees it shares one in."""
        names, prefix, new, shingles = self.sets(texts)
        rows: list[list] = [[i, doc_id, names[i], None, None, None] for i, doc_id in enumerate(ids)]
        if len(new):
            distinct = np.unique(prefix)
            cuts, numbers = by_bucket(distinct, self.buckets)
            shared = np.concatenate([np.unpackbits(np.frombuffer(answers[0][int(b)], np.uint8), count=e - a) for a, e, b in zip(cuts[:-1], cuts[1:], numbers, strict=True)])
            shared = shared[np.searchsorted(distinct, prefix)].astype(bool)
            some = np.flatnonzero(shared.any(1))
            whole = self.signatures([shingles[k] for k in some], self.labels).astype(">u2")
            trees = shared @ (1 << np.arange(self.trees))
            for k, signature in zip(some, whole, strict=True):
                rows[new[k]][3:] = [pack_text(texts[new[k]]), signature.tobytes(), int(trees[k])]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["row", "doc_id", "item", "content", "marks", "trees"])

    def tries(self, items: DataFrame, stages: Stages) -> DataFrame:
        """(item, depth, keys): for each item and tree the longest prefix that another item has too, and the names of its prefixes from the floor on.

        All paths (tree, labels) are sorted; the longest common prefix of a path with any other is the one with
        a neighbour. Rows are dealt out by ranges of the sorted order, so a hot subtree is many tasks' work. The
        neighbours across two ranges are compared at the driver: two rows for each range.
        """
        size, floor = LABEL_BYTES * self.labels, self.floor
        parts = max(8, self.buckets // 16)

        def paths(batches):
            for batch in slices(batches):
                names, marks, trees = (c.to_pylist() for c in batch.columns)
                rows = [(t, m[t * size : (t + 1) * size], name) for name, m, has in zip(names, marks, trees, strict=True) for t in range(self.trees) if has >> t & 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["tree", "path", "item"])

        def neighbours(batches):
            held = pa.Table.from_batches(list(batches), schema=pa.schema([("tree", pa.int32()), ("path", pa.binary()), ("item", pa.binary())]))
            n = held.num_rows
            if not n:
                return
            tree = held.column("tree").to_numpy()
            labels = np.frombuffer(b"".join(held.column("path").to_pylist()), ">u2").astype(np.uint16).reshape(n, self.labels)
            same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
            left, right = np.concatenate([[-1], same]), np.concatenate([same, [-1]])
            border = np.zeros(n, bool)
            border[[0, -1]] = True
            keys = np.zeros((n, self.labels), U)
            with np.errstate(over="ignore"):
                key = tree.astype(U) + U(1)
                for d in range(self.labels):
                    key = mix(key * U(0x9E3779B97F4A7C15) + labels[:, d])
                    keys[:, d] = key
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys[:, floor - 1 :].reshape(-1).view(np.int64)), self.labels - floor + 1).cast(pa.list_(pa.int64()))
            columns = [pa.array(border), held.column("tree"), held.column("path"), held.column("item"), pa.array(left, pa.int32()), pa.array(right, pa.int32()), keys]
            yield from pa.table(columns, names=[c.split()[0] for c in _TRIE.split(", ")]).to_batches(max_chunksize=1 << 14)
            release()

        paths_ = items.select("item", "marks", "trees").mapInArrow(paths, "tree int, path binary, item binary")
        ordered = paths_.repartitionByRange(parts, "tree", "path", "item").sortWithinPartitions("tree", "path", "item")
        trie = stages.write(ordered.mapInArrow(neighbours, _TRIE), "tries", self.parts)
        ends = sorted(trie.filter("border").select("tree", "path", "item", "left", "right", "keys").collect(), key=lambda r: (r.tree, bytes(r.path), bytes(r.item)))
        mended = []
        for k, r in enumerate(ends):
            left, right = r.left, r.right
            if left < 0:
                left = _common_labels(ends[k - 1], r) if k else 0
            if right < 0:
                right = _common_labels(r, ends[k + 1]) if k + 1 < len(ends) else 0
            mended.append((bytes(r.item), max(left, right), r.keys))
        inner = trie.filter("not border").select("item", F.greatest("left", "right").alias("depth"), "keys")
        return inner.unionByName(items.sparkSession.createDataFrame(mended, "item binary, depth int, keys array<long>")).filter(F.col("depth") >= floor)


def _common_labels(a, b) -> int:
    if a.tree != b.tree:
        return 0
    size = LABEL_BYTES
    n = 0
    while n < len(a.path) and a.path[n : n + size] == b.path[n : n + size]:
        n += size
    return n // size


def pack_text(text: bytes) -> bytes:
    """A text compressed, its length before it."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpack_text(content: bytes) -> bytes:
    return pa.decompress(content[8:], int.from_bytes(content[:8], "little"), codec="zstd", asbytes=True)


def _links(stages: Stages, items: DataFrame, forest: _Forest, threshold: float, target: float) -> DataFrame:
    """(item, root, links) of all linked pairs found, from rounds over ever shorter prefixes.

    The first round compares items that agree in a whole signature of some tree. A pair of known similarity
    tells how many like it were missed at a depth, so each round's links give its recall; while it is
    under the target, the matched prefix is shortened to the longest that promises it. A round compares
    only pairs that no earlier one has: under nodes that branch between its depth and the last one's. At
    the floor, which promises the target for any pair, it ends.
    """
    tries = stages.write(forest.tries(items, stages), "depths", forest.parts)
    depth, last, found = forest.labels, None, None
    while True:
        key = F.col("keys")[depth - forest.floor]
        members = tries.filter(F.col("depth") >= depth).select(key.alias("group"), *([F.col("keys")[last - forest.floor].alias("child")] if last else []), "item")
        if last:
            branching = members.groupBy("group").agg(F.min("child").alias("a"), F.max("child").alias("b")).filter("a <> b").select("group")
            members = members.join(branching, "group", "left_semi").select("group", "item")
        links = link_groups(members, items, threshold, forest.shingles, stages, 4 * forest.buckets, marks=forest.at_depth(depth), seen=forest.at_depth(last) if last else None, weigh=forest.misses)
        links = stages.write(links, f"links{depth}", forest.parts)
        stages.drop(*WORK_TABLES)
        found = links if found is None else found.unionByName(links)
        if depth == forest.floor:
            return found
        sums = found.agg(F.sum("pairs"), *(F.sum(F.col("weights")[d]) for d in range(forest.labels - forest.floor + 1))).first()
        reached = [d for d in range(depth, forest.floor - 1, -1) if sums[0] and sums[0] >= target * (sums[0] + sums[1 + d - forest.floor] / MISS_UNIT)]
        if reached and reached[0] == depth:
            return found
        depth, last = reached[0] if reached else forest.floor, depth


def _classes(stages: Stages, chunks: DataFrame, forest: _Forest, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(nodes: a row per document with its set), (classes: item, label, class_id, n_links)."""
    some, few = forest.parts, light_parts(forest.buckets)
    found = stages.write(ask(chunks, forest.prefixes, forest.answer_prefixes), "prefixes", some)
    nodes = stages.write(each_chunk(with_replies(chunks, found), forest.nodes, _NODES), "nodes", some)
    stages.drop("prefixes")
    sets = stages.write(nodes.groupBy("item").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least")), "sets", some)
    full = nodes.filter("content is not null").groupBy("item").agg(F.first("content").alias("content"), F.first("marks").alias("marks"), F.max("trees").alias("trees"))
    items = stages.write(full.join(sets.select("item", "weight"), "item"), "items", some)
    links = _links(stages, items, forest, threshold, target)
    labels = components(stages, links, few)
    degree = links.groupBy("item").agg(F.sum("links").alias("links"))
    classed = sets.join(labels, "item", "left").join(degree, "item", "left")
    classed = stages.write(classed.select("item", F.coalesce("label", "item").alias("label"), "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classed", some)
    least = stages.write(classed.groupBy("label").agg(F.min("least").alias("class_id")), "least", some)
    return nodes, stages.write(classed.join(least, "label").select("item", "label", "class_id", "n_links"), "classes", some)


def _forest(docs: DataFrame, threshold: float, trees: int, labels: int, target: float, shingle: int) -> _Forest:
    forest = _Forest(shingle, trees, labels, floor_depth(threshold, trees, labels, target), bucket_count(docs))
    forest.parts = work_parts(docs)
    return forest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE_WORDS, trees: int = TREES, labels: int = LABELS, target: float = TARGET_RECALL, chunk_chars: int | None = None) -> DataFrame:
    """doc_id, class_id, n_links of each row.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle`` words (unchanged,
    between ASCII white space) is ``threshold`` or more. n_links counts the other documents a document
    is linked to, equal sets included, without listing them; class_id is the smallest id among the
    documents connected by links.

    Documents with one set are one item. An item has a MinHash signature of ``labels`` labels in each of
    ``trees`` prefix tries. Chunks learn from hash buckets which of their prefixes of the least useful
    length two sets share, so only such items travel, their texts compressed. Their signatures are sorted;
    matched prefixes are shortened round by round until the links found show a recall of ``target``. Every
    pair under a node is compared exactly, block by block, and links become classes by distributed
    union-find.

    A text of fewer words than a shingle has is one shingle; texts without a word, null ones included,
    equal each other. Null ids stand behind all others in class_id; repeated rows are documents of
    their own; an empty table gives no rows; other columns are not read.
    """
    stages = Stages(docs.sparkSession, "ngram-join")
    chunks = stages.write(make_chunks(docs, id_col, text_col, chunk_chars), "chunks")
    nodes, classes = _classes(stages, chunks, _forest(docs, threshold, trees, labels, target, shingle), threshold, target)
    return nodes.select("doc_id", "item").join(classes, "item").select("doc_id", "class_id", "n_links").coalesce(work_parts(docs))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE_WORDS, trees: int = TREES, labels: int = LABELS, target: float = TARGET_RECALL, chunk_chars: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of the smallest id stays in each class.

    Of rows with that id the first read stays, so repeated rows leave one; texts without a word, null ones
    included, are one class; a null id stands behind all others and stays if its class has no other; an
    empty table gives no rows; other columns may have any name.
    """
    stages = Stages(docs.sparkSession, "ngram-keep")
    others = [c for c in docs.columns if c != text_col]
    chunks = stages.write(make_chunks(docs, id_col, text_col, chunk_chars, others), "chunks")
    nodes, classes = _classes(stages, chunks, _forest(docs, threshold, trees, labels, target, shingle), threshold, target)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "chunk", "row")
    best = nodes.groupBy("item").agg(F.min(place).alias("place")).join(classes.select("item", "label"), "item").groupBy("label").agg(F.min("place").alias("place"))
    kept = best.select("place.chunk", "place.row").groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    schema, where = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for content, rows in zip(batch.column("content"), batch.column("rows"), strict=True):
                table = pa.ipc.open_stream(content.as_py()).read_all().take(pa.array(sorted(rows.as_py())))
                columns = table.columns[2:]
                columns.insert(where, table.column(1))
                yield from pa.table(columns, names=schema.names).to_batches()
        release()

    return chunks.join(kept.hint("merge"), "chunk").select("content", "rows").mapInArrow(run, schema).coalesce(work_parts(docs))
