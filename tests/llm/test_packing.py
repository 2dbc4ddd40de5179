import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gapgraph.llm import packing

BPE = packing.public_byte_bpe()
ENCODER = packing.load_encoder(**BPE)


def pack(df, **how):
    return packing.pack_documents(df, **BPE, **how).collect()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(pieces, docs, tokenizer):
    """Every id of every document in one piece, sequences gapless and without padding."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for i, texts in want.items():
        assert sum(p.length for p in got[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(got[i], key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(texts[0]), zlib.crc32(texts[0][at : at + p.length].tobytes()))
                at += p.length
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == s[0].tier and at & (at - 1) == 0 and at <= 1024
    return sequences


def test_whole_table(docs, rows, tokenizer):
    sequences = check(pack(docs), rows, tokenizer)
    assert sum(s[0].tier == 1024 for s in sequences.values()) > 0.5 * len(sequences)


def test_several_flushes(docs, rows, tokenizer):
    check(pack(docs, pool_tokens=4096, step_tokens=4096), rows, tokenizer)


def test_step_groups_are_balanced(docs):
    load = defaultdict(int)
    for p in pack(docs, step_tokens=8192):
        load[p.step_group] += p.length
    assert max(load.values()) <= min(load.values()) + 1024


def test_odd_rows(odd, none, tokenizer):
    check(pack(odd), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], tokenizer)
    assert pack(none) == []


def test_with_ids(odd):
    for p in pack(odd, with_ids=True):
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32


def test_long_text_in_parts(tokenizer):
    text = ("It's a test, isn't it?  Numbers 123 and   spaces\n\n and <|endoftext|> ünïcode. 漢字、かな。\u3000x\x85\x1c y" * 50) + "x" * 500
    encoder = packing.load_encoder(**BPE)
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert 50256 in want
    for size, run in ((97, 2), (97, 1 << 16), (1 << 20, 3)):
        assert packing.encode(encoder, text, size, run).tolist() == want


@pytest.mark.parametrize("text", ["\n" * 2_000_000, " " * 1_500_000 + "x", "a" + "\t " * 600_000 + "<|endoftext|> b", "7" * 1_000_000, "漢字" * 300_000, "漢字、" * 300_000, "#*" * 500_000])
def test_very_long_texts(tokenizer, text):
    assert packing.encode(packing.load_encoder(**BPE), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(st.sampled_from("ab '\n\t\u3000漢、.7<"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_parts_and_runs(tokenizer, text):
    assert packing.encode(ENCODER, text, 5, 2).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 3000), max_size=60), st.sampled_from([600, 5000, 1 << 19]))
@settings(max_examples=60, deadline=None)
def test_packer(sizes, pool):
    packer = packing.Packer(0, pool_tokens=pool, step_tokens=4096)
    found = []
    for k, n in enumerate(sizes):
        packer.add(np.arange(n, dtype="<u4"), k)
        if packer.held >= pool:
            found += packer.pack()
    found += packer.pack(last=True)
    seen = defaultdict(list)
    for _, tier, _, window in found:
        assert sum(len(ids) for ids, *_ in window) == tier and tier & (tier - 1) == 0
        for ids, doc, start, total in window:
            assert total == sizes[doc] and ids[0] == start
            seen[doc] += ids.tolist()
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}
    assert len({s for s, *_ in found}) == len(found)
