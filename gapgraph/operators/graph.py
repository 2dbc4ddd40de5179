"""The causal graph: edges and nodes of claims, and removal of cycles."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gapgraph.operators.merge import filter_edges, merge_claims, normalize_claims
from gapgraph.sources.document import to_document, write_parts
from gapgraph.stages import Stages

#: Cycles among up to so many edges are found in one task, in memory that follows their number.
SMALL_EDGES = 500_000


@dataclass
class KnowledgeGraph:
    """edges: all that reach the thresholds; dag: those left when cycles are gone; nodes: of all edges."""

    edges: DataFrame
    dag: DataFrame
    nodes: DataFrame
    claims: DataFrame

    def papers_analyzed(self) -> int:
        return self.claims.agg(F.count_distinct("source_paper")).first()[0]

    def _head(self) -> tuple[int, str]:
        return self.papers_analyzed(), datetime.now(timezone.utc).isoformat()

    def _ordered_nodes(self) -> DataFrame:
        return self.nodes.select("node", F.col("node_key").alias("ord"))

    def to_document(self, gaps: DataFrame | None = None, hypotheses: DataFrame | None = None, model_used: str = "unknown") -> DataFrame:
        return to_document(self.edges.sparkSession, self._ordered_nodes(), self.edges, self.claims, gaps, hypotheses, *self._head(), model_used)

    def write_parts(self, path: str, gaps: DataFrame | None = None, hypotheses: DataFrame | None = None, model_used: str = "unknown") -> None:
        """The graph's document in parts: for one that is too large for a row."""
        write_parts(self.edges.sparkSession, path, *self._head(), model_used, nodes=self._ordered_nodes(), edges=self.edges, claims=self.claims, gaps=gaps, hypotheses=hypotheses)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, node_key): ends of edges; node_key orders them as edges name them, cause first."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.struct(F.col("edge_key").alias("e"), F.lit(i).alias("end")).alias("k")) for i, c in enumerate(("cause", "effect"))))))
    return ends.groupBy("node").agg(F.min("k").alias("node_key"))


def _strong_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes one node of its strongly connected component, the same for all of them (Tarjan, without recursion)."""
    order = np.argsort(u, kind="stable")
    heads, ends = v[order].tolist(), np.searchsorted(u[order], np.arange(1, n + 1)).tolist()
    at = [0, *ends[:-1]]
    seen, low, label = [0] * n, [0] * n, [-1] * n
    waiting: list[int] = []
    clock = 0
    for root in np.unique(u).tolist():
        path = [] if seen[root] else [root]
        while path:
            x = path[-1]
            if not seen[x]:
                clock += 1
                seen[x] = low[x] = clock
                waiting.append(x)
            if at[x] < ends[x]:
                y = heads[at[x]]
                at[x] += 1
                if not seen[y]:
                    path.append(y)
                elif label[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == seen[x]:
                while label[x] < 0:
                    label[waiting.pop()] = x
    found = np.array(label, np.int64)
    return np.where(found < 0, np.arange(n), found)


def weakest_of_cycles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges u -> v, given from the strongest to the weakest, are the weakest of a cycle.

    An edge is if its ends are in one strong component of the edges down to itself. A span of ranks is
    halved: edges whose ends the stronger half joins are decided in that half, all others in the weaker
    one, between components instead of nodes. So each halving looks at each edge once.
    """
    gone = np.zeros(len(u), bool)
    spans = [(0, len(u) - 1, np.arange(len(u)), u, v)]
    while spans:
        low, high, edge, a, b = spans.pop()
        if not (edge >= low).any():
            continue
        middle = (low + high) // 2
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        strong = edge <= middle
        label = _strong_components(len(names), a[strong], b[strong])
        joined = label[a] == label[b]
        if low == high:
            gone[edge[joined & (edge == low)]] = True
            continue
        gone[edge[joined & ~strong]] = True
        spans.append((low, middle, edge[joined & strong], a[joined & strong], b[joined & strong]))
        spans.append((middle + 1, high, edge[~joined], label[a[~joined]], label[b[~joined]]))
    return gone


def _small(edges: DataFrame) -> DataFrame:
    """Removed edges of a graph that fits one task."""

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["avg_confidence", "cause", "effect"], ascending=False)
        ends = pd.factorize(pd.concat([pdf["cause"], pdf["effect"]]))[0].astype(np.int64)
        return pdf[weakest_of_cycles(ends[: len(pdf)], ends[len(pdf) :])][["cause", "effect"]]

    return edges.select("cause", "effect", "avg_confidence", F.lit(0).alias("graph")).groupBy("graph").applyInPandas(close, "cause string, effect string")


def _peel(edges: DataFrame, stages: Stages) -> DataFrame:
    """Without edges at nodes that nothing enters or nothing leaves, again and again: what may lie on cycles."""
    n, k = -1, 0
    while True:
        size = edges.count()
        if size == n or not size:
            return edges
        n, k = size, k + 1
        edges = edges.join(edges.select(F.col("effect").alias("cause")).distinct(), "cause", "left_semi").join(edges.select(F.col("cause").alias("effect")).distinct(), "effect", "left_semi")
        edges = stages.write(edges, f"peel{k}")


def _large(edges: DataFrame, small_edges: int) -> DataFrame:
    """Removed edges of a graph of any size.

    What can't lie on a cycle is peeled off first; the core goes to one task if it is small enough. Else
    widest paths decide: an edge goes if a path back exists whose weakest edge is stronger than it. Paths
    double in length with each round, and each round is a written table.
    """
    stages = Stages(edges.sparkSession, "cycles")
    core = _peel(edges.select("cause", "effect", F.struct("avg_confidence", "cause", "effect").alias("rk")), stages)
    if core.isEmpty():
        return core.select("cause", "effect")
    if _fits(core, small_edges):
        return _small(core.select("cause", "effect", "rk.avg_confidence"))
    wide, size, k = stages.write(core.select(F.col("cause").alias("u"), F.col("effect").alias("v"), "rk"), "wide0"), None, 0
    while True:
        now = wide.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v", "rk"), F.lit(1 << 31)))).first()
        if now == size:
            break
        size, k = now, k + 1
        after = wide.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("rk").alias("rk2"))
        longer = wide.join(after, "v").select("u", F.col("w").alias("v"), F.least("rk", "rk2").alias("rk"))
        wide = stages.write(wide.unionByName(longer).groupBy("u", "v").agg(F.max("rk").alias("rk")), f"wide{k}")
        stages.drop(f"wide{k - 1}")
    back = wide.select(F.col("v").alias("cause"), F.col("u").alias("effect"), F.col("rk").alias("back"))
    return core.join(back, ["cause", "effect"]).filter("back > rk").select("cause", "effect")


def _fits(edges: DataFrame, small_edges: int) -> bool:
    return edges.limit(small_edges + 1).count() <= small_edges


def cycle_edges(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(cause, effect) of each edge that is the weakest of some simple cycle; ties by cause, then effect."""
    return _small(edges) if _fits(edges, small_edges) else _large(edges, small_edges)


def remove_cycles(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """The edges that are the weakest of no cycle; what is left has no cycle. Nodes are not touched."""
    return edges.join(cycle_edges(edges, small_edges), ["cause", "effect"], "left_anti")


def build_graph(claims: DataFrame, min_confidence: float = 0.5, min_papers: int = 1) -> KnowledgeGraph:
    """Claims to a graph: names normalised, claims merged, thresholds applied, cycles removed."""
    stages = Stages(claims.sparkSession, "graph")
    edges = stages.write(filter_edges(merge_claims(normalize_claims(claims)), min_confidence, min_papers), "edges")
    return KnowledgeGraph(edges, stages.write(remove_cycles(edges), "dag"), graph_nodes(edges), claims)
