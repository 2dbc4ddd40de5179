import numpy as np
from hypothesis import given, settings, strategies as st

from gapgraph.llm import hashing, near
from gapgraph.llm.chunks import CHUNK_CHARS, MAX_CHUNK_CHARS, chunk_size

POWERS = hashing.Powers()


@given(st.lists(st.text("ab \t\né", max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = hashing.Words(raw, POWERS)
    want = [(i, x) for i, t in enumerate(raw) for x in t.split()]
    got = [(int(i), bytes(w.data[a:b])) for i, a, b in zip(w.text, w.start, w.end, strict=True)]
    assert got == want
    assert len(set(w.hash.tolist())) == len({x for _, x in want})
    assert [w.first_word[i + 1] - w.first_word[i] for i in range(len(raw))] == [len(t.split()) for t in raw]


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 13))
@settings(max_examples=120, deadline=None)
def test_runs(values, k):
    arr = np.array(values, np.uint64)
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    for hashes in (hashing.windows(hashing.mix(arr + np.uint64(1)), k), hashing.grams(arr, k)):
        assert len(hashes) == len(runs)
        assert len(set(zip(hashes.tolist(), runs, strict=True))) == len(set(runs)) == len(set(hashes.tolist()))


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20), min_size=1, max_size=10), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_minhash(sets, block):
    values = np.array([x for s in sets for x in s], np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    multipliers = np.array([1, 3, 0x9E3779B1], np.uint32)
    got = hashing.minhash(values, starts, multipliers, block)
    assert got.tolist() == [[min(x * int(m) % 2**32 for x in s) for m in multipliers] for s in sets]


@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_common(sets):
    got = near._common([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(a & b) for b in sets] for a in sets]


def test_chunks_follow_buckets():
    sizes = [chunk_size(1 << k) for k in range(6, 21)]
    assert sizes == sorted(sizes) and set(sizes[:9]) == {CHUNK_CHARS} and sizes[-1] == MAX_CHUNK_CHARS
    assert chunk_size(1 << 18) == 32 << 20
