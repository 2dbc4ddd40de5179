"""Exact verification of candidate groups, and connected components of the links found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapgraph.llm.chunks import light_parts
from gapgraph.llm.common import Stages, release

#: Items of a block. A group of n items is compared block by block, (n / BLOCK)^2 / 2 tasks' worth of rows.
BLOCK = 512
#: Columns of an incidence matrix made at once.
COLUMNS = 2048
#: Tables of link_groups() that are used up once its result is written.
WORK_TABLES = ("groups", "candidates-labels", "labelled-groups", "whole")
_FAR = np.iinfo(np.int64).max


def all_marks(packed: list[bytes]) -> np.ndarray:
    """Rows of 64-bit integers, as they are."""
    return np.stack([np.frombuffer(m, np.int64) for m in packed])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values = np.concatenate(sets) if sets else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    column, owner = column[shared], owner[shared]
    out = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
        for a in range(0, int(column[-1]) + 1, COLUMNS):
            low, high = np.searchsorted(column, [a, a + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[low:high], column[low:high] - a] = 1
            out += part @ part.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _units(members: DataFrame, stages: Stages, block: int, files: int) -> DataFrame:
    """(group, item, blocks, whole): what is compared together, in how many blocks.

    Groups with the same members are compared once. Groups that share items form a candidate component;
    where sending each of its items to all blocks of the component is less than sending the members of
    its groups one by one, the component is compared as a whole, else its groups are.
    """
    # components are of 64-bit hashes: a clash joins two components, and no comparison is lost by that
    hashed = members.withColumn("h", F.xxhash64("item"))
    sizes = hashed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(7), "item"), F.lit(1 << 31))).alias("s"), F.min("h").alias("root"))
    once = sizes.filter("n > 1").groupBy("n", "x", "s").agg(F.min("group").alias("group"), F.min("root").alias("root")).select("group", "root", "n")
    kept = stages.write(hashed.join(once, "group"), "groups", files)
    labels = components(stages, kept.select(F.col("h").alias("item"), "root"), files, "candidates")
    labels = labels.select(F.col("item").alias("h"), "label")
    labelled = stages.write(kept.select("group", "item", "n", "h").join(labels, "h").drop("h"), "labelled-groups", files)
    per_label = labelled.groupBy("label").agg(F.sum(F.ceil(F.col("n") / block)).alias("sent"))
    size = labelled.select("label", "item").distinct()
    sizes = size.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    whole = stages.write(sizes.join(per_label, "label").filter(F.col("size") * F.ceil(F.col("size") / block) <= F.col("sent")).select("label", "size"), "whole", files)
    as_one = size.join(whole, "label").select(F.col("label").alias("group"), "item", F.ceil(F.col("size") / block).cast("int").alias("blocks"), F.lit(True).alias("whole"))
    apart = labelled.join(whole, "label", "left_anti").select("group", "item", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.lit(False).alias("whole"))
    return as_one.unionByName(apart)


def link_groups(
    members: DataFrame,
    items: DataFrame,
    threshold: float,
    decode: Callable[[list[bytes]], list[np.ndarray]],
    stages: Stages,
    parts: int,
    block: int = BLOCK,
    marks: Callable[[list[bytes]], np.ndarray] = all_marks,
    seen: Callable[[list[bytes]], np.ndarray] | None = None,
    weigh: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(item, root, links, pairs, weights): items of a group that are linked, from the exact Jaccard of every pair in a group.

    members: distinct (group long, item binary); items: (item, weight long, content binary, marks
    binary), from which ``marks`` makes all groups of each item as 64-bit integers, in columns that tell
    kinds of groups apart. ``decode`` gives the sorted distinct values of contents. A row has the weights
    of the partners found in ``links``, their number in ``pairs``, the sums of ``weigh`` of their
    similarities, and a ``root`` that the item is connected to. No pair is emitted, and each pair that
    shares a group is compared in one place: in the whole component, or in the least of its common groups;
    pairs that share one of the ``seen`` groups are left out. What is large is cut into blocks, and two
    blocks are a task's work; what fits a block is dealt out to ``parts`` lots.
    """
    placed = _units(members, stages, block, light_parts(parts // 4)).withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    pairs = placed.select("group", "whole", "blocks", "item", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lot = F.when(F.col("blocks") == 1, F.pmod("group", F.lit(parts)).cast("long")).otherwise(F.col("group"))
    pairs = pairs.select(lot.alias("lot"), (F.col("blocks") == 1).alias("small"), "group", "whole", "item", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(group: int, whole: bool, across: bool, own: np.ndarray, own_marks: np.ndarray, old: np.ndarray | None, weight: np.ndarray, contents: list[bytes]):
        """(member, root member, weight of partners, partners, their similarities weighed) of the linked members of one unit."""
        n = len(own)
        first = np.full((n, n), _FAR)
        for mark in own_marks.T:
            np.minimum(first, np.where(mark[:, None] == mark[None, :], mark[:, None], _FAR), out=first)
        mine = first < _FAR if whole else first == group
        mine &= (own[:, None] != own[None, :]) if across else ~np.eye(n, dtype=bool)
        for mark in old.T if old is not None else ():
            mine &= mark[:, None] != mark[None, :]
        some = np.flatnonzero(mine.any(1))
        if not len(some):
            return
        both = _common(decode([contents[i] for i in some]))
        size = np.diag(both)
        union = size[:, None] + size[None, :] - both
        linked = mine[np.ix_(some, some)] & (both >= threshold * union - 1e-9)
        if not linked.any():
            return
        links, label = linked @ weight[some], np.arange(len(some))
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], len(some)).min(1))
            if (least == label).all():
                break
            label = least
        for i in np.flatnonzero(linked.any(1)):
            alike = both[i][linked[i]] / union[i][linked[i]]
            yield int(some[i]), int(some[label[i]]), int(links[i]), len(alike), weigh(alike).tolist() if weigh else []

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("group").combine_chunks()
        group, whole, own, low, high, weight = (table.column(c).to_numpy() for c in ("group", "whole", "own", "low", "high", "weight"))
        packed = table.column("marks").to_pylist()
        mark, old = marks(packed), seen(packed) if seen else None
        names, contents = table.column("item"), table.column("content")
        found: list[tuple] = []
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                # the contents of one unit at a time
                for i, r, *more in compare(group[a], whole[a], low[a] != high[a], own[a:b], mark[a:b], old[a:b] if seen else None, weight[a:b], contents.slice(a, b - a).to_pylist()):
                    found.append((names[a + i].as_py(), names[a + r].as_py(), *more))
        release()
        columns = list(zip(*found, strict=True)) or [[]] * 5
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "root", "links", "pairs", "weights"])

    full = pairs.join(items.select("item", "weight", "content", "marks"), "item")
    return full.groupBy("lot", "small", "low", "high").applyInArrow(verify, "item binary, root binary, links long, pairs long, weights array<long>")


def components(stages: Stages, links: DataFrame, files: int, name: str = "components") -> DataFrame:
    """(item, label): the component of each item that stands in a row (item, root) with two different items.

    Distributed union-find by contraction. In each round every node hooks to its least neighbour, one
    hash-ordered node in two or more thus going, and edges are redrawn between what is left; rounds
    follow the logarithm of the longest chain. Each round is a written table; labels are composed and
    written at the end, and the rounds' tables go. A hot node costs one row a task, since minima are taken before the shuffle.
    """
    edges = links.filter("item <> root").select(F.col("item").alias("u"), F.col("root").alias("v"))
    edges = stages.write(edges.union(edges.select("v", "u")).distinct(), f"{name}-edges0", files)
    hooks = []
    while not edges.isEmpty():
        k = len(hooks)
        hook = stages.write(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}-hook{k}", files)
        hooks.append(hook)
        left = edges.join(hook, "u").select(F.col("p").alias("a"), "v")
        both = left.join(hook.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").filter("a <> b")
        edges = stages.write(both.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-edges{k + 1}", files)
        stages.drop(f"{name}-edges{k}")
    stages.drop(f"{name}-edges{len(hooks)}")
    if not hooks:
        return links.sparkSession.createDataFrame([], f"item {links.schema['item'].dataType.simpleString()}, label {links.schema['item'].dataType.simpleString()}")
    labels = hooks[0].select(F.col("u").alias("item"), F.col("p").alias("label"))
    for hook in hooks[1:]:
        step = hook.select(F.col("u").alias("label"), "p")
        labels = labels.join(step, "label", "left").select("item", F.coalesce("p", "label").alias("label"))
    labels = stages.write(labels, f"{name}-labels", files)
    stages.drop(*(f"{name}-hook{k}" for k in range(len(hooks))))
    return labels
