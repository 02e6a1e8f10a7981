"""Connected components of an edge list by contraction; every step is a join or an aggregate of bounded rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: So few edges are joined up at once; more of them are contracted first.
REMNANT = 10_000


def _joined_up(edges: DataFrame) -> DataFrame:
    """(node, root) of at most REMNANT edges (u, v), in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
        return pd.DataFrame({"node": list(root), "root": [find(x) for x in list(root)]})

    kind = edges.schema["u"].dataType.simpleString()
    return edges.groupBy().applyInPandas(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; the root is the same for the nodes of one component.

    Each round maps every node onto the least node of its closed neighbourhood and contracts the edges; at most
    about half of the nodes survive a round, so rounds grow with the logarithm of the graph; a bounded remnant is joined up
    by union-find in one task.  Self-loops and nulls
    are ignored, repeated edges count once.  An empty edge list gives an empty result.
    """
    left, right = F.col(a), F.col(b)
    edges = edges.where(left.isNotNull() & right.isNotNull() & (left != right))
    edges = durable(edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).distinct())
    node = lambda e: e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    assigned = node(edges).withColumn("root", F.col("node"))
    while (left_over := edges.count()) > REMNANT:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        assigned = _stepped(assigned, parent.where("u != p"), "u", "p")
        first = edges.join(parent, "u").select(F.col("p").alias("x"), "v")
        second = parent.select(F.col("u").alias("v"), F.col("p").alias("y"))
        moved = first.join(second, "v").where("x != y")
        edges = durable(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    return durable(_stepped(assigned, _joined_up(edges), "node", "root")) if left_over else assigned


def _stepped(assigned: DataFrame, step: DataFrame, node: str, root: str) -> DataFrame:
    moves = step.select(F.col(node).alias("from_"), F.col(root).alias("to_"))
    return durable(assigned.join(moves, assigned["root"] == moves["from_"], "left").select("node", F.coalesce("to_", "root").alias("root")))
