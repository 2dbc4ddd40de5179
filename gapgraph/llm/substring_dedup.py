"""Repeated word spans across documents through a compacted de Bruijn graph."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapgraph.llm.chunks import ask, bucket_count, by_bucket, each_chunk, groups_of, make_chunks, with_replies, work_parts
from gapgraph.llm.common import Stages
from gapgraph.llm.hashing import Powers, Words, windows

#: Words of an edge of the graph, and so the shortest span that counts as repeated.
EDGE_WORDS = 13
#: Words of a seed; every edge has the same smallest seed wherever it stands.
SEED_WORDS = 5
NONE, MANY = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
#: A null id counts as larger than any.
LAST_ID = (1 << 63) - 1
REPEATED, LEFT, RIGHT = 1, 2, 4

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Graph:
    """The edges of one chunk: the hash of each k words in a row, and its smallest seed."""

    def __init__(self, texts: list[bytes], powers: Powers, k: int, s: int):
        words = Words(texts, powers)
        self.first_word = words.first_word
        self.edge = windows(words.hash, k)
        n = len(self.edge)
        self.text = words.text[:n]
        self.whole = self.text == words.text[k - 1 : k - 1 + n]  # not across two texts
        low, span = windows(words.hash, s), k - s + 1
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest and len(low) > rest else low
        self.seed = low[:n]


def _twice(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and whether each stands in two texts or more."""
    order = np.argsort(values, kind="stable")
    values, text = values[order], text[order]
    group = groups_of(values)
    n = int(group[-1]) + 1 if len(group) else 0
    low, high = np.full(n, 1 << 62), np.full(n, -1)
    np.minimum.at(low, group, text)
    np.maximum.at(high, group, text)
    return values[np.searchsorted(group, np.arange(n))] if n else values, high > low


def _count(size: int, bits: int) -> int:
    """How many items of ``bits`` bits, each with a flag of one bit before them all, take ``size`` bytes."""
    n = 8 * size // (bits + 1)
    return next(x for x in (n, n - 1, n + 1) if x >= 0 and (x + 7) // 8 + bits // 8 * x == size)


def _lookup(distinct: np.ndarray, replies: dict[int, bytes], buckets: int, kind) -> np.ndarray:
    """The replies for a chunk's sorted distinct hashes, in their order."""
    _, numbers = by_bucket(distinct, buckets)
    return np.concatenate([np.frombuffer(replies[int(b)], kind) for b in numbers]) if len(numbers) else np.zeros(0, kind)


class _Dedup:
    """The questions of one run: seeds, then edges, then paths."""

    def __init__(self, k: int, s: int, buckets: int):
        self.k, self.s, self.buckets = k, s, buckets
        self.powers = Powers()

    # 1: which seeds stand in two documents; most edges go no further

    def seeds(self, ids, texts, answers):
        graph = Graph(texts, self.powers, self.k, self.s)
        seed, twice = _twice(graph.seed[graph.whole], graph.text[graph.whole])
        cuts, numbers = by_bucket(seed, self.buckets)
        for a, b, number in zip(cuts[:-1], cuts[1:], numbers, strict=True):
            # five bytes below the bucket's bits tell seeds apart well enough to choose candidates
            low = (seed[a:b] << np.uint64(self.buckets.bit_length() - 1)) >> np.uint64(24)
            packed = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield int(number), np.packbits(twice[a:b]).tobytes() + packed.tobytes()

    @staticmethod
    def answer_seeds(parts):
        sizes = [_count(len(p), 40) for p in parts]
        values, flags = [], []
        for n, p in zip(sizes, parts, strict=True):
            head = (n + 7) // 8
            flags.append(np.unpackbits(np.frombuffer(p, np.uint8, head), count=n))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(p, np.uint8, offset=head).reshape(n, 5)
            values.append(wide.reshape(-1).view("<u8"))
        value, flag = np.concatenate(values), np.concatenate(flags)
        order = np.argsort(value, kind="stable")
        group = groups_of(value[order])
        many = (np.bincount(group) > 1) | (np.bincount(group, weights=flag[order]) > 0)
        out = np.zeros(len(value), np.uint8)
        out[order] = many[group]
        return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    def _candidates(self, texts, seed_replies):
        graph = Graph(texts, self.powers, self.k, self.s)
        seed = np.unique(graph.seed[graph.whole])
        hit = _lookup(seed, seed_replies, self.buckets, np.uint8).astype(bool)
        at = graph.whole.copy()
        at[graph.whole] = hit[np.searchsorted(seed, graph.seed[graph.whole])]
        return graph, np.flatnonzero(at)

    # 2: which candidate edges are repeated, and which have one edge before or after them wherever they stand

    def edges(self, ids, texts, answers):
        graph, at = self._candidates(texts, answers[0])
        if not len(at):
            return
        edge, text, n = graph.edge[at], graph.text[at], len(graph.edge)

        def beside(step: int) -> np.ndarray:
            there = at + step
            inside = (there >= 0) & (there < n)
            there = np.where(inside, there, 0)
            inside &= graph.whole[there] & (graph.text[there] == text)
            return np.where(inside, graph.edge[there], NONE)

        order = np.argsort(edge, kind="stable")
        group = groups_of(edge[order])
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        distinct, twice = _twice(edge, text)
        sides = []
        for step in (-1, 1):
            value = beside(step)[order]
            one = value[first]
            differs = np.bincount(group, weights=value != one[group]) > 0
            sides.append(np.where(differs, MANY, one))
        cuts, numbers = by_bucket(distinct, self.buckets)
        for a, b, number in zip(cuts[:-1], cuts[1:], numbers, strict=True):
            yield int(number), np.packbits(twice[a:b]).tobytes() + np.stack([distinct[a:b], sides[0][a:b], sides[1][a:b]]).tobytes()

    @staticmethod
    def answer_edges(parts):
        sizes = [_count(len(p), 192) for p in parts]
        twice = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, (n + 7) // 8), count=n) for n, p in zip(sizes, parts, strict=True)])
        edge, left, right = np.concatenate([np.frombuffer(p[(n + 7) // 8 :], np.uint64).reshape(3, n) for n, p in zip(sizes, parts, strict=True)], axis=1)
        order = np.argsort(edge, kind="stable")
        group = groups_of(edge[order])
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        flags = REPEATED * ((np.bincount(group) > 1) | (np.bincount(group, weights=twice[order]) > 0)).astype(np.uint8)
        for bit, side in ((LEFT, left[order]), (RIGHT, right[order])):
            one = side[first]
            same = np.bincount(group, weights=side != one[group]) == 0
            flags |= (bit * (same & (one != MANY) & (one != NONE))).astype(np.uint8)
        out = np.zeros(len(edge), np.uint8)
        out[order] = flags[group]
        return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    def _paths(self, texts, answers):
        """(text, first edge, last edge) of each maximal nonbranching path of repeated edges, as word offsets in its text."""
        graph, at = self._candidates(texts, answers[0])
        if not len(at):
            return []
        edge = graph.edge[at]
        distinct = np.unique(edge)
        flags = _lookup(distinct, answers[1], self.buckets, np.uint8)[np.searchsorted(distinct, edge)]
        keep = (flags & REPEATED) > 0
        at, flags = at[keep], flags[keep]
        if not len(at):
            return []
        linked = (at[1:] == at[:-1] + 1) & (graph.text[at[1:]] == graph.text[at[:-1]]) & ((flags[:-1] & RIGHT) > 0) & ((flags[1:] & LEFT) > 0)
        heads = np.flatnonzero(np.concatenate([[True], ~linked]))
        tails = np.append(heads[1:], len(at)) - 1
        text = graph.text[at[heads]]
        base = graph.first_word[text]
        return list(zip(text.tolist(), (at[heads] - base).tolist(), (at[tails] - base).tolist(), strict=True))

    def _digests(self, texts, answers):
        """Per path its text, first word, end word and the digest of its words."""
        words, of = None, -1
        for text, a, b in self._paths(texts, answers):
            if text != of:
                words, of = texts[text].split(), text
            yield text, a, b + self.k, hashlib.blake2b(b" ".join(words[a : b + self.k]), digest_size=24).digest()

    # 3: which is the smallest document with each path, word for word

    def paths(self, ids, texts, answers):
        least: dict[bytes, int] = {}
        for text, _, _, digest in self._digests(texts, answers):
            doc = LAST_ID if ids[text] is None else ids[text]
            least[digest] = min(doc, least.get(digest, LAST_ID))
        parts: dict[int, list[bytes]] = {}
        for digest in sorted(least):
            parts.setdefault(int.from_bytes(digest[:4], "big") % self.buckets, []).append(digest + least[digest].to_bytes(8, "little", signed=True))
        for number, rows in parts.items():
            yield number, b"".join(rows)

    @staticmethod
    def answer_paths(parts):
        least: dict[bytes, bytes] = {}
        for p in parts:
            for i in range(0, len(p), 32):
                digest, doc = p[i : i + 24], p[i + 24 : i + 32]
                known = least.get(digest)
                if known is None or int.from_bytes(doc, "little", signed=True) < int.from_bytes(known, "little", signed=True):
                    least[digest] = doc
        return [b"".join(p[i : i + 24] + least[p[i : i + 24]] for i in range(0, len(p), 32)) for p in parts]

    def spans(self, ids, texts, answers) -> dict[int, list[tuple[int, int]]]:
        """text -> word spans that a smaller document holds too."""
        least = {p[i : i + 24]: int.from_bytes(p[i + 24 : i + 32], "little", signed=True) for p in answers[2].values() for i in range(0, len(p), 32)}
        out: dict[int, list[tuple[int, int]]] = {}
        for text, a, b, digest in self._digests(texts, answers):
            if least[digest] < (LAST_ID if ids[text] is None else ids[text]):
                out.setdefault(text, []).append((a, b))
        return out


def _repeats(docs: DataFrame, id_col: str, text_col: str, k: int, s: int, chunk_chars: int | None):
    stages = Stages(docs.sparkSession, "substrings")
    run = _Dedup(k, s, bucket_count(docs))
    chunks = stages.write(make_chunks(docs, id_col, text_col, chunk_chars), "chunks")
    seeds = stages.write(ask(chunks, run.seeds, run.answer_seeds), "seeds", work_parts(docs))
    edges = stages.write(ask(with_replies(chunks, seeds), run.edges, run.answer_edges), "edges", work_parts(docs))
    paths = stages.write(ask(with_replies(chunks, seeds, edges), run.paths, run.answer_paths), "paths", work_parts(docs))
    return run, with_replies(chunks, seeds, edges, paths)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = EDGE_WORDS, s: int = SEED_WORDS, chunk_chars: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row without the words that repeat a smaller document.

    Words (between ASCII white space) are vertices' letters, each k in a row an edge of a de Bruijn
    graph. Chunks of documents ask hash buckets three times, each answer being joined back by chunk:

    1. Seeds. An edge's smallest s-word hash is the same wherever it stands, so only edges whose seed
       is in two documents can repeat.
    2. Edges. A repeated edge learns whether it has one successor and one predecessor everywhere.
       Edges linked both ways are compacted to nonbranching paths. All occurrences of such an edge
       lie in the same whole path, so a path's documents are those of each of its edges.
    3. Paths. The words at a path's source coordinates are digested (192 bits); equal digests are the
       same span, word for word, and the smallest id among them is found. A clash of edge hashes can
       split a path but cannot make two different spans equal.

    A span is removed from each document with a larger id than the smallest that holds it. A null text
    has no words; a null id counts as larger than any id; rows with one id never remove each other's
    words; an empty table gives no rows; other columns are not read. ``with_text`` adds kept_text.
    """
    run, chunks = _repeats(docs, id_col, text_col, k, s, chunk_chars)

    def rows(ids, texts, answers):
        spans = run.spans(ids, texts, answers)
        out = []
        for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for a, b in spans.get(i, ()):
                gone[a] += 1
                gone[b] -= 1
            kept = words
            if i in spans:
                stay = np.cumsum(gone)[: len(words)] == 0
                kept = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
            left = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), *([left.decode()] if with_text else [])))
        types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return each_chunk(chunks, rows, SCHEMA + (", kept_text string" if with_text else "")).coalesce(work_parts(docs))
