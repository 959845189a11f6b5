"""Connected components of an edge table by repeated contraction, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the undirected edges (a, b); root is the same for all nodes of a component.

    Each round every node moves to the least node among itself and its neighbours, then once more along that choice,
    and the edges are drawn between where their ends have moved.  At least half the nodes go each round, so the rounds
    grow with the logarithm of the largest component.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    moved = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        parent = materialise(parent, "parents")
        twice = parent.join(parent.select(F.col("n").alias("p"), F.col("p").alias("pp")), "p").select("n", "pp")
        twice = materialise(twice, "parents")
        moved = materialise(moved.join(twice, F.col("root") == F.col("n"), "left").select("node", F.coalesce("pp", "root").alias("root")), "moved")
        ends = edges.join(twice.select(F.col("n").alias("a"), F.col("pp").alias("pa")), "a").join(twice.select(F.col("n").alias("b"), F.col("pp").alias("pb")), "b")
        edges = materialise(ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return moved
