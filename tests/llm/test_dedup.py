import random

import brute
import pytest
from pyspark.sql import functions as F

from gapgraph.llm import chunks, line_dedup, near, ngram_join, queries, substring_dedup
from gapgraph.llm.common import Stages


def substring(df, **how):
    return sorted(tuple(r) for r in substring_dedup.drop_repeats(df, **how).collect())


def test_substrings(docs, rows):
    assert substring(docs) == sorted(brute.repeats(rows))


def test_substrings_in_small_chunks(docs, rows):
    few = docs.filter("doc_id < 60").repartition(3)
    assert substring(few, chunk_chars=5000) == sorted(brute.repeats([r for r in rows if r[0] < 60]))


def test_substrings_of_odd_rows(odd, none):
    got = [tuple(r) for r in substring_dedup.drop_repeats(odd, with_text=True).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert [r[1:3] for r in by[1]] == [(20, 0), (20, 0)]
    assert by[2][0][1:3] == (20, 20) and by[2][0][4] == ""
    assert sorted(r[1:3] for r in by[None]) == [(0, 0), (20, 20)]
    assert len(got) == odd.count() and substring(none) == []


def test_branching_paths(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(80), 2))
        text = base[a:b] + [f"x{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        texts.append(" ".join(text * rng.randrange(1, 3)))
    rows = list(enumerate(texts))
    assert substring(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=800) == sorted(brute.repeats(rows))


def joined(df, **how):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **how).collect()), key=repr)


def test_near(docs, rows):
    assert joined(docs) == sorted(brute.near(rows), key=repr)


def test_near_group_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"y{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.near(rows), key=repr)
    assert joined(df, chunk_chars=3000) == want
    real = near.link_groups
    monkeypatch.setattr(ngram_join, "link_groups", lambda *a, **how: real(*a, block=7, **how))
    assert joined(df) == want


def test_near_of_odd_rows(odd, none):
    got = joined(odd)
    assert len(got) == odd.count() and joined(none) == []
    by = {}
    for i, c, n in got:
        by.setdefault(i, []).append((c, n))
    assert by[1] == [(1, 3), (1, 3)] and by[2] == [(1, 3)] and (1, 3) in by[None]
    assert by[4] == [(3, 3)] and by[6] == [(6, 0)] and by[7] == [(7, 0)]


def test_keep_one(odd, docs, rows):
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    assert ids == sorted([1, 3, 6, 7, 8, 9], key=repr)
    got = {r.doc_id for r in ngram_join.keep_one_of_each(docs).select("doc_id").collect()}
    assert got == {c for _, c, _ in brute.near(rows)}


@pytest.mark.parametrize(("threshold", "trees", "depth"), [(0.8, 24, 5), (0.5, 24, 1), (0.95, 24, 8)])
def test_floor_depth(threshold, trees, depth):
    assert ngram_join.floor_depth(threshold, trees, 8, 0.9999) == depth


def alike(rng, k, n=100):
    """k near copies of a text, of ever lower similarity."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    out = []
    for i in range(k):
        w = list(base)
        w[: i + 1] = [f"y{rng.randrange(10**9)}" for _ in range(i + 1)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("low", "high", "depths"), [(0.96, 1.0, [8]), (0.8, 1.0, [8, 6]), (0.8, 0.92, [8, 5])])
def test_prefixes_are_shortened_until_the_recall_is_met(spark, monkeypatch, low, high, depths):
    rng = random.Random(3)
    texts = []
    while len(texts) < 400:
        n = 100
        same = int(n * rng.uniform(low + 0.01, high))
        base = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        # the last words differ, so the similarity of the shingles is known
        other = base[: same + 4] + [f"y{rng.randrange(10**9)}" for _ in range(n - same)]
        if brute.similar({0: brute.shingles(" ".join(base)), 1: brute.shingles(" ".join(other))}, low):
            texts += [" ".join(base), " ".join(other)]
    rows = list(enumerate(texts))
    seen = []
    real = ngram_join.link_groups
    def spy(*a, marks, **how):
        seen.append(marks)
        return real(*a, marks=marks, **how)
    at_depth, asked = ngram_join._Forest.at_depth, []
    monkeypatch.setattr(ngram_join._Forest, "at_depth", lambda self, d: asked.append(d) or at_depth(self, d))
    monkeypatch.setattr(ngram_join, "link_groups", spy)
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(brute.near(rows), key=repr)
    assert sorted(set(asked), reverse=True) == depths and len(seen) == len(depths)


def test_sorted_tries(spark):
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in alike(rng, 6)]
    forest = ngram_join._Forest(5, 24, 8, 2, 64)
    sets, names = forest.split([t.encode() for t in texts])
    signature = forest.signatures(sets, 8)
    items = [(n, s.astype(">u2").tobytes(), (1 << 24) - 1) for n, s in zip(names, signature, strict=True)]
    got = forest.tries(spark.createDataFrame(items, "item binary, marks binary, trees int"), Stages(spark, "t")).collect()
    want = {}
    for i in range(len(texts)):
        for t in range(24):
            depth = max(next((d for d in range(8) if signature[i, t, d] != signature[j, t, d]), 8) for j in range(len(texts)) if j != i)
            if depth >= 2:
                want[names[i], int(forest.keys(signature)[i, t, 7].view("int64"))] = depth
    assert {(bytes(r.item), r["keys"][-1]): r.depth for r in got} == want


def test_measured_recall(docs, rows):
    """Links found over the whole table against brute force, at three thresholds."""
    for threshold in (0.6, 0.8, 0.9):
        want = sum(n for *_, n in brute.near(rows, threshold))
        got = sum(r.n_links for r in ngram_join.near_duplicates(docs, threshold=threshold, target=0.99).collect())
        assert 0.97 * want <= got <= want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)]
    u = brute.Union()
    for a, b in pairs:
        u.join(a, b)
    df = spark.createDataFrame([(bytes([a // 256, a % 256, 77]), bytes([b // 256, b % 256, 77])) for a, b in pairs], "item binary, root binary")
    got = {r.item[0] * 256 + r.item[1]: bytes(r.label) for r in near.components(Stages(spark, "t"), df, 4).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(u.find(x), got[x]) for x in nodes}) == len({u.find(x) for x in nodes}) == len({got[x] for x in nodes})


def lines(df, **how):
    return {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.kept) for r in line_dedup.line_classes(df, **how).collect()}


def test_lines(docs, rows):
    want = brute.line_classes(rows)
    assert lines(docs) == {k: (v, k == v) for k, v in want.items()}


def test_lines_in_small_chunks(docs, rows):
    few = docs.filter("doc_id < 80").repartition(3)
    want = brute.line_classes([r for r in rows if r[0] < 80])
    assert lines(few, chunk_chars=6000) == {k: (v, k == v) for k, v in want.items()}


def test_lines_of_odd_rows(odd, none):
    got = line_dedup.line_classes(odd).collect()
    cat = [r for r in got if r.line_no == 0 and r.doc_id in (1, 2, None)]
    assert len(cat) == 4 and sum(r.kept for r in cat) == 1 and {r.class_doc for r in cat} == {1}
    assert lines(none) == {}
    left = line_dedup.drop_repeated_lines(odd)
    assert left.schema == odd.schema
    assert sorted((r.doc_id for r in left.select("doc_id").collect()), key=repr) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None], key=repr)
    assert left.filter("doc_id = 9").select("text").first()[0] == "naïve Ünïcode 😀 text\r\nwith lines\n\nand more"


def test_drop_lines(docs, rows):
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute.drop_lines(rows)
    assert docs.count() == len(rows) and not docs.filter(F.col("text").isNull()).count()


SHORT = [
    (1, "En laleen the river rises every spring\nLes.\n\n  Les.  \nabcdefghijk"),
    (2, "Les.\nabcdefghijkl\nLes\nAnd ornd.\n😀"),
    (3, "And ornd.\nabcdefg\nabcdefgh\nabcdefg x"),
    (4, "abcdefg\n😀\nab cd ef gh\nLes.\nx\n \nabcdefghijk"),
]


def test_short_lines(spark, sf, docs, rows):
    df = spark.createDataFrame(SHORT, "doc_id long, text string").repartition(3)
    got = lines(df, chunk_chars=40)
    assert got == {k: (v, k == v) for k, v in brute.line_classes(SHORT).items()}
    assert got[4, 3] == ((1, 1), False) and got[2, 1] == ((1, 4), False) and got[3, 1] == ((3, 1), True) and got[2, 2] == ((2, 2), True)
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert left[4] == "ab cd ef gh\nx\n " and left[1].split("\n")[1:] == ["Les.", "", "abcdefghijk"]
    assert left[3] == "abcdefg\nabcdefgh\nabcdefg x"
    found = {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.kept) for r in queries.op6_fuzzy_line_dedup(spark, str(sf)).collect()}
    assert found == {k: (v, k == v) for k, v in brute.line_classes(rows).items()}


def test_bucket_count(spark, docs):
    assert chunks.bucket_count(docs) == chunks.MIN_BUCKETS == chunks.bucket_count(spark.range(3))
    assert chunks.bucket_count(spark.createDataFrame([(1, "x")], "doc_id long, text string")) in (chunks.MIN_BUCKETS, chunks.UNKNOWN_BUCKETS)
    assert chunks.bucket_count(spark.createDataFrame(spark.sparkContext.parallelize([(1, "x")]), "doc_id long, text string")) == chunks.UNKNOWN_BUCKETS
