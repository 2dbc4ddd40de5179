"""Hierarchical multi-length packing of tokenized documents into context windows."""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.common import compact, release

#: Context sizes of the tiers; the largest is the training window.
TIERS = (64, 128, 256, 512, 1024)
#: Tokens of one optimizer step; step groups come out near this size.
STEP_TOKENS = 1 << 16
#: Tokens that wait in the tiers of one task before they are packed; bounds memory.
POOL_TOKENS = 1 << 19
#: A longer text is tokenized in parts, cut where no token can cross.
PART_CHARS = 1 << 20
#: A run of so much white space is a token's worth of its own: the pattern's look-ahead would back up through all of it.
LONG_RUN = 1 << 16
#: White space as the pattern's \\s has it (the Unicode property).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No pre-token goes on from another character to white space, nor from a letter to a punctuation mark.
_CUT = re.compile(f"(?<=[^{_WS}])[{_WS}]|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def load_encoder(ranks_path: str, pattern: str, special_tokens: dict[str, int] | None = None):
    """A byte-level BPE encoder for a rank file; ``special_tokens`` in a text get their ids, as a tokenizer's added tokens do."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special_tokens or {})


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file."""
    with open(json_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def public_byte_bpe(name: str = "byte_bpe_50k") -> dict:
    """pack_documents()'s arguments for a byte-level BPE of the installed public tokenizers: the ids of ``name``.json, from its rank file."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN, "special_tokens": added_tokens(public_tokenizers.path(f"{name}.json"))}


def _parts(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _runs(encoder, text: str, long_run: int) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is a long white-space run that is one pre-token.

    The last character of such a run goes with what follows, unless a special token or nothing does.
    """
    at = 0
    for run in re.finditer(f"[{_WS}]{{{long_run},}}", text):
        end = run.end()
        if end < len(text) and not any(text.startswith(t, end) for t in encoder.special_tokens_set):
            end -= 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def encode(encoder, text: str, part_chars: int = PART_CHARS, long_run: int = LONG_RUN) -> np.ndarray:
    """Token ids of a whole text, as unsigned 32-bit."""
    out = []
    for part in _parts(text, part_chars):
        for some, alone in _runs(encoder, part, long_run) if len(part) >= long_run else ((part, False),):
            if alone:
                out.append(np.array(encoder._encode_single_piece(some), "<u4"))
            elif some:
                out.append(encoder.encode_to_numpy(some, allowed_special="all"))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class Packer:
    """Packs the documents of one task.

    A piece is (ids, doc_id, start, doc_tokens). Each waits in the smallest tier that holds it;
    a tier's list is sorted by length. Windows are opened from the largest tier down, and a
    window's gap is filled with the longest piece of the shorter tiers that fits, else with a
    piece cut to the gap. What is left at the end is cut into power-of-two sequences.
    """

    def __init__(self, first_id: int, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.window = sorted(tiers), max(tiers)
        self.step_tokens, self.pool_tokens = step_tokens, pool_tokens
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.held, self.serial = 0, 0
        self.next_id, self.next_group = first_id, first_id
        self.full: list[tuple[int, list]] = []

    def add(self, ids: np.ndarray, doc_id) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.full.append((self.window, [(ids[at : at + self.window], doc_id, at, n)]))
            at += self.window
            self.held += self.window
        if at < n:
            self._wait((ids[at:], doc_id, at, n))
            self.held += n - at

    def _wait(self, piece) -> None:
        size = len(piece[0])
        self.serial += 1
        insort(self.pools[next(t for t in self.tiers if t >= size)], (size, self.serial, piece))

    def _longest(self, gap: int, below: int):
        """The longest waiting piece of the tiers up to ``below`` with at most ``gap`` tokens."""
        for tier in reversed(self.tiers):
            if tier <= below and (pool := self.pools[tier]):
                k = bisect_right(pool, (gap, float("inf")))
                if k:
                    return pool.pop(k - 1)[2]
        return None

    def _cut(self, gap: int):
        """The first ``gap`` tokens of a waiting piece, from the shortest tier that has a longer one."""
        for tier in self.tiers:
            if pool := self.pools[tier]:
                ids, doc_id, start, total = pool.pop()[2]
                self._wait((ids[gap:], doc_id, start + gap, total))
                return ids[:gap], doc_id, start, total
        return None

    def pack(self, last: bool = False) -> Iterator[tuple[int, int, int, list]]:
        """Yields (sequence id, tier, step group, pieces) of what is complete."""
        left = []
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.pools[tier].pop()[2]]
                gap = tier - len(window[0][0])
                while gap:
                    piece = self._longest(gap, tier) or self._cut(gap)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= len(piece[0])
                if gap:
                    left += window
                else:
                    self.full.append((tier, window))
        if last:
            self._tail(left)
        else:
            for piece in left:
                self._wait(piece)
        self.held = sum(len(p[0]) for p in left) if not last else 0
        yield from self._steps()

    def _tail(self, left: list) -> None:
        size = sum(len(p[0]) for p in left)
        while size:
            tier = min(self.window, 1 << (size.bit_length() - 1))
            size, need, window = size - tier, tier, []
            while need:
                ids, doc_id, start, total = left.pop(0)
                if len(ids) > need:
                    left.insert(0, (ids[need:], doc_id, start + need, total))
                    ids = ids[:need]
                window.append((ids, doc_id, start, total))
                need -= len(ids)
            self.full.append((tier, window))

    def _steps(self) -> Iterator[tuple[int, int, int, list]]:
        """Deals complete sequences, longest first, to the step group with the fewest tokens."""
        count = max(1, round(sum(t for t, _ in self.full) / self.step_tokens))
        load = [(0, g) for g in range(count)]
        import heapq

        for tier, window in sorted(self.full, key=lambda x: -x[0]):
            tokens, group = heapq.heappop(load)
            heapq.heappush(load, (tokens + tier, group))
            yield self.next_id, tier, self.next_group + group, window
            self.next_id += 1
        self.next_group += count
        self.full = []


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS, with_ids: bool = False, special_tokens: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document in a packed sequence; no shuffle.

    Each read partition packs what it holds: documents of a window or more give whole windows,
    remainders and short documents wait in context-size tiers. A sequence is exactly as long as
    its tier; only the last few of a task take smaller powers of two, so nothing is padded. Step
    groups are balanced within a task: they hold nearly equal token counts and a like mix of tiers;
    a task's last flush may make smaller ones. Memory is one record
    batch plus ``pool_tokens``; a retried task gives the same pieces and ids, because ids come
    from the partition's number and its file splits.

    A null text is an empty one and packs as the end id alone; a null id is kept; repeated rows
    are packed each for itself; an empty table gives no rows; other columns are not read.
    Very long texts are tokenized in parts, and runs of white space of any length are one
    pre-token. ``with_ids`` adds the token ids of each piece; ``special_tokens`` (``added_tokens`` of
    a tokenizer's file) in a text get their own ids, as the tokenizer gives them by default.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        encoder = load_encoder(ranks_path, pattern, special_tokens)
        packer = Packer(TaskContext.get().partitionId() << 36, tiers, step_tokens, pool_tokens)

        def rows(sequences):
            out = []
            for sequence, tier, group, window in sequences:
                offset = 0
                for ids, doc_id, start, total in window:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, tier, group, *([ids.astype(np.int32)] if with_ids else [])))
                    offset += len(ids)
            if out:
                types = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(encoder, text.as_py() or "")
                packer.add(np.append(ids, np.uint32(end_id)).astype("<u4"), doc_id)
                if packer.held >= pool_tokens:
                    yield from rows(packer.pack())
        yield from rows(packer.pack(last=True))
        release()

    return compact(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)
