"""Benchmark decontamination by pigeonhole piece hits and bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.common import compact, release

#: Edits allowed, as a share of an item's characters.
ERROR_SHARE = 0.1
#: Characters of test items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4 << 20
#: A document with fewer words than this after its leaked passages went is dropped.
MIN_WORDS = 5

SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def normal(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def normal_places(text: str) -> tuple[str, list[int]]:
    """normal(text), and for each of its characters the position in ``text`` it came from."""
    out: list[str] = []
    places: list[int] = []
    space = False
    for i, c in enumerate(text):
        if c.isspace():
            space = bool(out)
            continue
        if space:
            out.append(" ")
            places.append(i - 1)
            space = False
        # a sigma's lower case depends on its place; the whole text decides which one it is
        for x in c.lower():
            out.append(x)
            places.append(i)
    whole = normal(text)
    return (whole, places) if len(whole) == len(out) else ("".join(out), places)


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of a pattern to any substring of ``text`` and the first end (exclusive) with it, or None above ``limit``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return (best, end) if best <= limit else None


class Item:
    """A test item: its pieces, and the tree of spans through which a piece hit is verified.

    A span of n pieces may hold n - 1 edits. If the whole holds no more than its budget, so does one
    child of each span down to a piece without any: a hit climbs from its piece to the whole, and
    most chance hits end at the first, short step.
    """

    def __init__(self, number: int, text: str, share: float):
        self.number, self.text, self.size = number, text, len(text)
        self.budget = min(int(share * self.size), self.size - 1)
        n = self.budget + 1
        cut = [i * self.size // n for i in range(n + 1)]
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        stack = [(0, n)]
        while stack:
            a, b = stack.pop()
            for leaf in range(a, b):
                self.above[leaf].insert(0, (cut[a], cut[b], b - a - 1))
            if b - a > 1:
                mid = (a + b) // 2
                stack += [(a, mid), (mid, b)]
        for spans in self.above:
            spans.sort(key=lambda s: s[1] - s[0])
        self.pieces = [text[cut[i] : cut[i + 1]] for i in range(n)]
        self.starts = cut
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def _span(self, a: int, b: int) -> dict[str, int]:
        if (a, b) not in self.masks:
            self.masks[a, b] = _masks(self.text[a:b])
        return self.masks[a, b]

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(start, end, distance) of the match around a piece hit at ``at``, or None."""
        origin = at - self.starts[piece]
        for a, b, budget in self.above[piece][1:]:
            low, high = max(0, origin + a - budget), origin + b + budget
            if myers(self._span(a, b), b - a, text[low:high], budget) is None:
                return None
        low, high = max(0, origin - self.budget), origin + self.size + self.budget
        found = myers(self._span(0, self.size), self.size, text[low:high], self.budget)
        if found is None:
            return None
        distance, end = found
        back = myers(_masks(self.text[::-1]), self.size, text[low : low + end][::-1], self.budget)
        return low + end - (back[1] if back else self.size), low + end, distance


class Searcher:
    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = [Item(number, text, share) for number, text in items]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for q, piece in enumerate(item.pieces):
                pieces.setdefault(piece, []).append((k, q))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of disjoint matches of each item in a normalised text."""
        done: dict[int, int] = {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last - size + 1
            for k, q in owners:
                if at < done.get(k, 0):
                    continue
                found = self.items[k].verify(text, q, at)
                if found is not None:
                    start, end, distance = found
                    if start >= done.get(k, 0):
                        yield self.items[k].number, start, end, distance
                    done[k] = max(end, done.get(k, 0))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items that hold a character, in blocks of a bounded size."""
    block: list[tuple[int, str]] = []
    held = 0
    for number, raw in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct().toLocalIterator():
        text = normal(raw)
        if not text:
            continue
        block.append((number, text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, distance): where documents hold a test item within its error budget.

    Texts are compared in lower case with single spaces; the budget is ``share`` of an item's
    characters. start and end are code points of the text as given. The items are a query set: they
    are searched in blocks of ``block_chars``, each in one pass over all documents without a shuffle.
    Matches of one item in a document don't overlap. Null or blank texts and items match nothing;
    null item ids are left out; repeated documents are each reported, repeated items once per id and
    text; empty tables give no rows; other columns are not read.
    """
    rows = compact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    out = None
    for block in _blocks(items, item_id_col, item_text_col, block_chars):
        part = rows.mapInArrow(_search(block, share), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _matches(searcher: Searcher, text: str) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, distance) in code points of ``text``."""
    found = list(searcher.find(normal(text)))
    if not found:
        return []
    whole, places = normal_places(text)
    if whole != normal(text):
        found = list(searcher.find(whole))
    return [(k, places[a], places[b - 1] + 1, d) for k, a, b, d in found if b > a]


def _search(block: list[tuple[int, str]], share: float):
    def run(batches):
        searcher = Searcher(block, share)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(doc_id, *m) for m in _matches(searcher, text.as_py() or "")]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
        release()

    return run


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = ERROR_SHARE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with every leaked passage cut out of its text; documents of under ``min_words`` words after a cut go.

    Each block of items is one pass that rewrites the texts; rows without a leak, null texts
    included, stay as they are.
    """
    names, place = docs.columns, docs.columns.index(text_col)
    plain = compact(docs).toDF(*(f"c{i}" for i in range(len(names))))  # any name may stand in docs
    for block in _blocks(items, item_id_col, item_text_col, block_chars):
        plain = plain.mapInArrow(_cut(block, share, place, min_words), plain.schema)
    return plain.toDF(*names)


def _cut(block: list[tuple[int, str]], share: float, place: int, min_words: int):
    def run(batches):
        searcher = Searcher(block, share)
        for batch in batches:
            texts, keep = [], []
            for value in batch.column(place):
                text = value.as_py()
                spans = sorted((a, b) for _, a, b, _ in _matches(searcher, text or ""))
                if spans:
                    parts, at = [], 0
                    for a, b in spans:
                        parts.append(text[at : max(a, at)])
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                keep.append(not spans or len(text.split()) >= min_words)
            columns = [*batch.columns]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
        release()

    return run
