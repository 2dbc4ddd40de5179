import random
import string

import brute

from gapgraph.llm import decontaminate as D

BENCH = "item_id long, text string, doc_id long"


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], [chars[k], "q"], ["z"]])
    return "".join(chars)


def noise(rng, n):
    return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_myers():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        want = brute.edit_end(p, t)
        got = D.myers(D._masks(p), len(p), t, len(p))
        assert got[0] == want


def test_search_by_brute_force():
    rng = random.Random(4)
    items = [(k, D.normal(noise(rng, 14))) for k in range(12)]
    searcher = D.Searcher(items, 0.1)
    for _ in range(60):
        k, item = rng.choice(items)
        text = D.normal(f"{noise(rng, 20)} {edited(item, rng.randrange(14), rng)} {noise(rng, 20)}")
        found = {n for n, *_ in searcher.find(text)}
        assert found == {n for n, t in items if brute.edit_end(t, text) <= int(0.1 * len(t))}


def test_table(spark, docs, rows, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, D.normal(r.text)) for r in bench.collect()]
    exact = {(i, k) for i, t in rows for k, x in items if x in D.normal(t or "")}
    got = D.find_leaks(docs, bench).collect()
    assert exact and {(r.doc_id, r.item_id) for r in got} >= exact
    text = dict(rows)
    for r in got:
        part = D.normal(text[r.doc_id][r.start : r.end])
        item = dict(items)[r.item_id]
        assert brute.edit_end(item, part) == r.distance <= int(0.1 * len(item))


def test_places_and_cuts(spark, odd, none):
    item = "The Large cat of the house sleeps on the İstanbul carpet all day long, says the report"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "  ", 0), (None, item, 0), (1, item, 5)], BENCH)
    leak = item.upper().replace("CAT", "CATS").replace(" ", "\n ")
    rows = [(1, f"İ before it all {leak} after it all is said", "x"), (2, leak, "x"), (3, "clean text of some words", "x"), (3, "clean text of some words", "x"), (4, None, "x"), (None, leak + " and more words to keep it", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.find_leaks(df, bench).collect()), key=repr)
    assert [(a, b) for a, b, _ in got] == sorted([(1, 1), (2, 1), (None, 1)], key=repr) and all(1 <= d <= 4 for *_, d in got)
    left = D.remove_leaks(df, bench)
    assert left.schema == df.schema
    texts = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert texts == sorted([(1, "İ before it all  after it all is said"), (3, "clean text of some words"), (3, "clean text of some words"), (4, None), (None, " and more words to keep it")], key=repr)
    assert D.find_leaks(df, bench, block_chars=10).count() == 3
    assert D.find_leaks(none, bench).count() == D.find_leaks(odd, bench.limit(0)).count() == 0
    assert D.remove_leaks(odd, bench).count() == odd.count()
