"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import stage


def _hooks(edges: DataFrame) -> DataFrame:
    """(node, up): each node's neighbour, or itself, that comes first in a random order of nodes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    near = stage(
        both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        .select(F.col("a").alias("node"), F.least(rank("a"), "near")["v"].alias("up")), "cc-hooks")
    upper = near.select(F.col("node").alias("up"), F.col("up").alias("upper"))
    return near.join(upper, "up").select("node", F.col("upper").alias("up"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node.

    Contraction in rounds: every node hooks to its first neighbour in a hashed order (a ``min`` that
    combines on the map side, so a node with a third of all edges is no hot spot), nodes merge into
    what they hooked to, and edges inside a merged node go for good. The hashed order makes even a
    sorted chain shrink by a constant factor a round. Each round is written to the shared folder, so a
    lost executor costs one round at most.

    Null ends and loops are ignored; repeated edges change nothing; an empty table gives an empty one.
    """
    edges = stage(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "cc-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        hooks = stage(_hooks(edges), "cc-up")
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("label"))
        else:
            step = hooks.select(F.col("node").alias("label"), "up")
            labels = stage(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
        ends = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731,B023
        edges = stage(
            edges.join(ends("a"), "a").join(ends("b"), "b").where("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(),
            "cc-edges",
        )
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
