"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepress.plans.workdir import spill

#: edges that a task contracts at once
LOCAL_EDGES = 500_000


def forest(edges: Iterator[tuple]) -> list[tuple]:
    """(smallest node, node) of each node of ``edges`` but the smallest of its component, which comes alone, with itself."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = [(find(n), n) for n in list(parent) if find(n) != n]
    linked = {r for r, _ in out}
    return out + [(n, n) for n in parent if parent[n] == n and n not in linked]


def contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as the stars of their own components: the same links, fewer edges, short paths.

    Stars take further edges in as long as they fill half of ``LOCAL_EDGES`` at most.
    """
    held: list[tuple] = []
    for f in frames:
        held += zip(f["a"].tolist(), f["b"].tolist(), strict=True)
        if len(held) > LOCAL_EDGES:
            held = forest(iter(held))
            if len(held) > LOCAL_EDGES // 2:
                yield pd.DataFrame(held, columns=["a", "b"])
                held = []
    yield pd.DataFrame(forest(iter(held)), columns=["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Every task first contracts its own edges, where they lie. As long as more
    than ``LOCAL_EDGES`` are left, a round hooks every node to one of its
    neighbours and goes on with the graph of what they were hooked to, so a
    round reads what the one before left over and not the whole graph again:
    what is shuffled and written over all rounds grows as the first. One task
    finishes the rest, and the hooks are followed back from the last round to
    the first. The tables of each join are read from the shared folder, so a
    hub's many rows are an exchange of their own, which adaptive execution can
    split. Rows with a null end are ignored; a node whose only edge is to
    itself is its own component.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    kind = known.schema["a"].dataType.simpleString()
    contract = lambda df: df.mapInPandas(contracted, f"a {kind}, b {kind}")
    stars = spill(contract(known), "stars")
    if stars.count() <= LOCAL_EDGES:
        whole = spill(contract(stars.coalesce(1)).select(F.col("b").alias("node"), F.col("a").alias("component")), "labels")
        return whole.unionByName(whole.where("node <> component").select(F.col("component").alias("node"), "component").distinct())
    alone, left, hooks = stars.where("a = b").select(F.col("a").alias("node")).distinct(), stars.where("a <> b"), []
    while left.count() > LOCAL_EDGES:
        if len(hooks) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        hooks.append(spill(_hooked(left, len(hooks)), "hooks"))
        left = spill(contract(_moved(left, hooks[-1])), "stars")
    labels = spill(contract(left.coalesce(1)).select(F.col("b").alias("node"), F.col("a").alias("component")), "labels")
    for i in reversed(range(len(hooks))):
        labels = _followed(hooks[i], labels)
        if i == 1:
            # nodes of this round hold the smallest of each component, as the first hooks each to the smallest
            least = labels.groupBy("component").agg(F.min("node").alias("least"))
            labels = labels.join(least, "component").select("node", F.col("least").alias("component"))
        labels = spill(labels, "labels")
    return labels if alone.isEmpty() else labels.unionByName(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))


def _hooked(links: DataFrame, turn: int) -> DataFrame:
    """(node, to): every node of ``links`` and what it is hooked to, itself or a neighbour.

    By turns that is the smallest, which takes a star in at once, and the first
    in an order drawn anew, which leaves three nodes of four at most on
    average, whatever the graph; the smallest alone would walk along a path.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    if turn % 2 == 0:
        return ends.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to"))
    drawn = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    first = ends.groupBy("node").agg(F.min_by("other", drawn("other")).alias("to"), F.min(drawn("other")).alias("at"))
    return first.select("node", F.when(F.col("at") < drawn("node"), F.col("to")).otherwise(F.col("node")).alias("to"))


def _moved(links: DataFrame, hooks: DataFrame) -> DataFrame:
    """``links`` between what their ends are hooked to, without those that have become one."""
    own = lambda end: hooks.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
    return links.join(own("a"), "a").join(own("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))


def _followed(hooks: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``hooks``, given those of what they are hooked to; what has no label there is its own component."""
    known = labels.select(F.col("node").alias("to"), "component")
    return hooks.join(known, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
