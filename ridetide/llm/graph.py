"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridetide.llm.common import written


def _roots(edges: DataFrame) -> DataFrame:
    """Hook each node to its least neighbour, if that is smaller, and follow the hooks to their ends."""
    both = edges.select(F.col("a").alias("node"), F.least("a", "b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.least("a", "b").alias("root"))
    )
    hooks = written(both.groupBy("node").agg(F.min("root").alias("root")), "hooks")
    while True:
        ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
        moved = (F.col("root") != F.col("end")).alias("moved")
        jumped = written(hooks.join(ends, "root").select("node", F.col("end").alias("root"), moved), "hooks")
        hooks = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Each round hooks nodes to smaller neighbours, shortens the paths by pointer jumping and contracts
    the edges. Local minima at least halve per round, so both loops are logarithmic. Hot nodes only
    meet in aggregates with a map side and in plain joins.
    """
    edges = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    labels = _roots(edges)
    latest = labels
    while True:
        at_a = latest.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = latest.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = edges.join(at_a, "a").join(at_b, "b").where("ra != rb")
        edges = written(contracted.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
        latest = _roots(edges)
        moved = latest.select(F.col("node").alias("root"), F.col("root").alias("end"))
        labels = written(
            labels.join(moved, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels"
        )
