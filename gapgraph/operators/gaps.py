"""Gap detection on the graph: what has no cause, no effect, one tie only, or weak ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gapgraph.functions.scoring import gap_score
from gapgraph.functions.text import arrow, some_of, two_digits

#: An edge below this is weak; exactly this is not.
LOW_CONFIDENCE = 0.6


def edge_roles(edges: DataFrame) -> DataFrame:
    """Each edge once for each end: node, other end, role (0 the node is the effect, 1 it is the cause)."""
    shared = ["avg_confidence", "paper_count", "edge_key", arrow(F.col("cause"), F.col("effect")).alias("text")]
    into = edges.select(F.col("effect").alias("node"), F.col("cause").alias("other"), F.lit(0).alias("role"), *shared)
    return into.unionByName(edges.select(F.col("cause").alias("node"), F.col("effect").alias("other"), F.lit(1).alias("role"), *shared))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of nodes that edges touch."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("effect").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("cause").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def node_profile(edges: DataFrame) -> DataFrame:
    """Per node its degrees, papers, strongest and mean confidence, neighbours (sorted), edges (causes, then effects), and the sum of its distinct neighbours' degrees."""
    roles = edge_roles(edges)
    own = roles.groupBy("node").agg(
        F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("in_degree"),
        F.sum(F.when(F.col("role") == 1, 1).otherwise(0)).alias("out_degree"),
        F.sum(F.coalesce("paper_count", F.lit(1))).alias("papers"),
        F.max(F.coalesce("avg_confidence", F.lit(1.0))).alias("strongest"),
        F.try_divide(F.sum(F.round(F.col("avg_confidence") * 1e6).cast("long")), F.count("avg_confidence") * 1e6).alias("mean_confidence"),
        F.array_sort(F.collect_set("other")).alias("neighboring_nodes"),
        F.transform(F.array_sort(F.collect_list(F.struct("role", "edge_key", "other", "text"))), lambda x: F.struct(x["role"].alias("role"), x["other"].alias("other"), x["text"].alias("text"))).alias("ties"),
    )
    degree = degrees(edges).select(F.col("node").alias("other"), (F.col("in_degree") + F.col("out_degree")).alias("d"))
    near = roles.select("node", "other").distinct().join(degree, "other").groupBy("node").agg(F.sum("d").alias("neighbour_degrees"))
    return own.join(near, "node")


def _side(role: int) -> Column:
    return F.transform(F.filter("ties", lambda t: t["role"] == role), lambda t: t["other"])


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def detect_gaps(edges: DataFrame, nodes: DataFrame | None = None, missing_cause_min_children: int = 2, low_confidence: float = LOW_CONFIDENCE, low_conf_scope: str = "middle") -> DataFrame:
    """The gaps of an acyclic graph: the six fields of a gap, and gap_key, which orders equal scores.

    - MISSING_CAUSE: no cause, and ``missing_cause_min_children`` effects or more
    - MISSING_EFFECT: a cause, but no effect
    - ISOLATED_NODE: one edge (such a node may be a missing effect as well)
    - LOW_CONFIDENCE_CHAIN: causes and effects, all edges below ``low_confidence``; with the scope
      "edge" any node with a weak edge
    nodes (node, node_key) gives the order of nodes; without it they are taken from the edges.
    """
    from gapgraph.operators.graph import graph_nodes

    profile = node_profile(edges).join(nodes if nodes is not None else graph_nodes(edges), "node")
    parents, children, name = _side(0), _side(1), F.col("node")
    i, o = F.col("in_degree"), F.col("out_degree")
    weak = (i >= 1) & (o >= 1) & (F.col("strongest") < low_confidence) if low_conf_scope == "middle" else F.col("weakest") < low_confidence
    if low_conf_scope != "middle":
        profile = profile.join(edge_roles(edges).groupBy("node").agg(F.min(F.coalesce("avg_confidence", F.lit(1.0))).alias("weakest")), "node")
    kinds = [
        (i.eqNullSafe(0) & (o >= missing_cause_min_children), "MISSING_CAUSE", 0, 0, _say("'", name, "' is said to lead to ", some_of(children), ", but no paper names a cause of it.")),
        ((i >= 1) & (o == 0), "MISSING_EFFECT", 0, 1, _say("'", name, "' is said to follow from ", some_of(parents), ", but no paper names an effect of it.")),
        (i + o == 1, "ISOLATED_NODE", 0, 2, _say("'", name, "' has one edge only, ", F.get("ties", F.lit(0))["text"], ", so its place among the other variables is open.")),
        (weak, "LOW_CONFIDENCE_CHAIN", 1, 3, _say("The chain from ", some_of(parents, 2), " over '", name, "' to ", some_of(children, 2), " rests on weak evidence (mean confidence ", two_digits(F.col("mean_confidence")), ").")),
    ]
    found = F.array(*(F.when(cond, F.struct(F.lit(kind).alias("gap_type"), F.lit(phase).alias("phase"), F.lit(order).alias("type_ord"), text.alias("gap_explanation"))) for cond, kind, phase, order, text in kinds))
    rows = profile.withColumn("g", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return rows.select(
        name.alias("variable"),
        F.col("g.gap_type").alias("gap_type"),
        gap_score(F.col("neighbour_degrees"), F.col("papers"), F.col("g.gap_type")).alias("gap_score"),
        "neighboring_nodes",
        F.transform("ties", lambda t: t["text"]).alias("existing_edges"),
        F.col("g.gap_explanation").alias("gap_explanation"),
        F.struct(F.col("g.phase").alias("phase"), F.col("node_key").alias("node"), F.col("g.type_ord").alias("type")).alias("tie"),
    ).select("variable", "gap_type", "gap_score", "neighboring_nodes", "existing_edges", "gap_explanation", F.struct((-F.col("gap_score")).alias("s"), "tie").alias("gap_key"))


def top_gaps(gaps: DataFrame, n: int) -> DataFrame:
    """The n best gaps with their rank from 1."""
    from pyspark.sql import Window

    return gaps.orderBy("gap_key").limit(n).withColumn("rank", F.row_number().over(Window.orderBy("gap_key")))


def broken_chains(all_edges: DataFrame, dag: DataFrame) -> DataFrame:
    """BROKEN_CHAIN (ours): nodes of the unfiltered edges whose neighbours lie in two or more components of the final graph.

    Returns variable and gap_type. Components are of the undirected final graph.
    """
    component = undirected_components(dag)
    roles = edge_roles(all_edges).select("node", "other").distinct()
    met = roles.join(component.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.count_distinct("component").alias("n"))
    return met.filter("n >= 2").select(F.col("node").alias("variable"), F.lit("BROKEN_CHAIN").alias("gap_type"))


def undirected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least name that a node is connected to.

    Labels take the least label around them, then that of the node they name, until nothing changes;
    both steps take minima before the shuffle, and each round is a written table.
    """
    from gapgraph.stages import Stages

    stages = Stages(edges.sparkSession, "components")
    pairs = edges.select(F.col("cause").alias("u"), F.col("effect").alias("v"))
    pairs = stages.write(pairs.union(pairs.select("v", "u")).distinct(), "pairs")
    label = stages.write(pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("c")), "label0")
    k = 0
    while True:
        k += 1
        around = pairs.join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("cv"))
        step = label.join(around, "u").select("u", "c", F.least("c", "cv").alias("n"))
        jumped = step.join(step.select(F.col("u").alias("n"), F.col("n").alias("nn")), "n").select("u", "c", F.least("n", "nn").alias("n"))
        new = stages.write(jumped, f"label{k}")
        if new.filter("n <> c").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("n").alias("component"))
        label = new.select("u", F.col("n").alias("c"))
