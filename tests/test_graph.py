import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgraph.operators import gaps as G, merge
from gapgraph.operators.claims import dedup_within_paper
from gapgraph.operators.graph import build_graph, cycle_edges, weakest_of_cycles

CLAIM = "claim_seq long, cause string, effect string, confidence double, mechanism string, source_paper string, evidence string"


def claims(spark, rows):
    return spark.createDataFrame([(i, c, e, conf, m, p, ev) for i, (c, e, conf, p, m, ev) in enumerate(rows)], CLAIM)


def edges(spark, rows):
    return spark.createDataFrame([(c, e, conf, n, (-conf, i)) for i, (c, e, conf, n) in enumerate(rows)], "cause string, effect string, avg_confidence double, paper_count int, edge_key struct<c:double,q:long>")


def test_merge(spark):
    said = [(0.35, "trial", "Heat stress", "They fell."), (0.65, "review", "heat stress ", "they fell."), (0.2, "review", " ", "They fell. "), (0.6, "trial", "UNKNOWN", ""), (0.7, "note", "was not specified here", "They fell.")]
    row = merge.merge_claims(claims(spark, [("drought", "crop yield", c, p, m, e) for c, p, m, e in said])).first()
    assert (row.avg_confidence, row.paper_count, row.mechanisms, row.evidence_sentences) == (0.5, 3, ["Heat stress"], ["They fell.", "they fell."])


def test_same_paper_twice_after_normalising(spark):
    rows = [("A.", "b", 0.4, "p", "", ""), ("a", "b", 0.6, "p", "", ""), ("a", " A ", 0.9, "p", "", "")]
    out = merge.merge_claims(merge.normalize_claims(claims(spark, rows))).collect()
    assert [(r.cause, r.effect, r.avg_confidence, r.paper_count, r.mechanisms) for r in out] == [("a", "b", 0.5, 1, [])]


def test_threshold_is_inclusive_on_the_rounded_mean(spark):
    rows = [("a", "b", 0.49996, "p", "", "")]
    assert merge.filter_edges(merge.merge_counts(claims(spark, rows)), 0.5, 1).count() == 1


def test_dedup_within_paper(spark):
    rows = [(0, 0, 0, "a", "b", 0.5, "m0"), (0, 0, 1, "c", "d", 0.9, "m1"), (0, 1, 0, "a", "b", 0.8, "m2"), (0, 1, 1, "a", "b", 0.8, "m3")]
    df = spark.createDataFrame([(*r, "p", "") for r in rows], "paper_ord long, chunk_ord int, claim_ord int, cause string, effect string, confidence double, mechanism string, source_paper string, evidence string")
    out = dedup_within_paper(df).orderBy("claim_seq").collect()
    assert [(r.cause, r.confidence, r.mechanism) for r in out] == [("a", 0.8, "m2"), ("c", 0.9, "m1")]


def weakest(rows):
    """Brute force: the least edge of every simple cycle."""
    order = {(u, v): (w, u, v) for u, v, w, _ in rows}
    nodes = sorted({x for e in order for x in e})
    gone = set()
    for n in range(2, len(nodes) + 1):
        for ring in itertools.permutations(nodes, n):
            if ring[0] == min(ring):
                walk = list(zip(ring, ring[1:] + ring[:1], strict=True))
                if all(e in order for e in walk):
                    gone.add(min(walk, key=order.get))
    return gone


@pytest.mark.parametrize(
    ("rows", "gone"),
    [
        ([("a", "b", 0.9, 1), ("b", "a", 0.6, 1)], {("b", "a")}),
        ([("a", "b", 0.9, 1), ("b", "c", 0.8, 1), ("c", "a", 0.7, 1), ("b", "a", 0.6, 1)], {("c", "a"), ("b", "a")}),
        ([("a", "b", 0.5, 1), ("b", "c", 0.8, 1), ("c", "a", 0.9, 1), ("c", "b", 0.7, 1)], {("a", "b"), ("c", "b")}),
        ([("a", "b", 0.5, 1), ("b", "c", 0.8, 1)], set()),
    ],
)
def test_cycles(spark, rows, gone):
    for small in (1500, 0):
        assert {tuple(r) for r in cycle_edges(edges(spark, rows), small).collect()} == gone


def test_cycles_by_brute_force(spark):
    for seed in range(6):
        rng = random.Random(seed)
        pairs = [(u, v) for u in "abcdef" for v in "abcdef" if u != v and rng.random() < 0.4]
        rows = [(u, v, rng.choice([0.5, 0.6, 0.7, 0.8]), 1) for u, v in pairs]
        if rows:
            for small in (1500, 0) if seed < 2 else (1500,):
                assert {tuple(r) for r in cycle_edges(edges(spark, rows), small).collect()} == weakest(rows)


def test_weakest_by_reachability():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        n, m = rng.integers(1, 12), rng.integers(0, 40)
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        reach, want = np.eye(n, dtype=bool), []
        for a, b in zip(u, v, strict=True):
            want.append(reach[b, a])
            reach |= reach[:, a][:, None] & reach[b][None, :]
        assert weakest_of_cycles(u, v).tolist() == want


def test_weakest_of_long_and_many():
    n = 50_000
    ring = np.arange(n)
    assert np.flatnonzero(weakest_of_cycles(ring, (ring + 1) % n)).tolist() == [n - 1]
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 40_000, 100_000), rng.integers(0, 40_000, 100_000)
    gone = weakest_of_cycles(u, v)
    assert gone.any() and not weakest_of_cycles(u[~gone], v[~gone]).any()


def test_peeled_core_fits_a_task(spark):
    rows = [("a", "b", 0.9, 1), ("b", "c", 0.8, 1), ("c", "a", 0.7, 1), ("c", "d", 0.2, 1), ("d", "e", 0.3, 1)]
    assert [tuple(r) for r in cycle_edges(edges(spark, rows), 3).collect()] == [("c", "a")]


GAPS = [
    ([("a", "b", 0.9, 1)], [("b", "MISSING_EFFECT", 0.372788, ["a"]), ("a", "ISOLATED_NODE", 0.312788, ["b"]), ("b", "ISOLATED_NODE", 0.312788, ["a"])]),
    (
        [("a", "b", 0.55, 1), ("b", "c", 0.59, 2)],
        [("b", "LOW_CONFIDENCE_CHAIN", 0.497778, ["a", "c"]), ("c", "MISSING_EFFECT", 0.476787, ["b"]), ("c", "ISOLATED_NODE", 0.416787, ["b"]), ("a", "ISOLATED_NODE", 0.366059, ["b"])],
    ),
]


@pytest.mark.parametrize(("rows", "want"), GAPS)
def test_gaps(spark, rows, want):
    got = G.detect_gaps(edges(spark, rows)).orderBy("gap_key").collect()
    assert [(r.variable, r.gap_type, round(r.gap_score, 6), r.neighboring_nodes) for r in got] == want


def test_gap_options(spark):
    one = edges(spark, [("a", "b", 0.9, 1)])
    kinds = {(r.variable, r.gap_type) for r in G.detect_gaps(one, missing_cause_min_children=1).collect()}
    assert ("a", "MISSING_CAUSE") in kinds
    weak = G.detect_gaps(edges(spark, [("a", "b", 0.3, 1)]), low_conf_scope="edge").filter(F.col("gap_type") == "LOW_CONFIDENCE_CHAIN")
    assert {r.variable for r in weak.collect()} == {"a", "b"}
    assert G.detect_gaps(edges(spark, [("a", "b", 0.6, 1), ("b", "c", 0.6, 1)])).filter(F.col("gap_type") == "LOW_CONFIDENCE_CHAIN").isEmpty()


def test_empty(spark):
    graph = build_graph(claims(spark, []))
    assert graph.edges.count() == graph.dag.count() == graph.nodes.count() == 0
    assert G.detect_gaps(graph.dag, graph.nodes).isEmpty()


def test_components(spark):
    got = {r.node: r.component for r in G.undirected_components(edges(spark, [("b", "a", 1.0, 1), ("b", "c", 1.0, 1), ("y", "x", 1.0, 1)])).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
