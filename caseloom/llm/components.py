"""Connected components of a graph that is only ever seen as a table of edges.

Every round each node takes the smallest of itself and its neighbours as its parent (a minimum, combined before the
shuffle, so a node with very many edges is no burden), follows two more parents, and the edges are drawn anew between
what the nodes point to; edges inside one node vanish. The smallest node of a component always stays itself, so the last
node left is the smallest one. Each round is written to the shared folder; nothing but the question whether any edge is
left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.lineage import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``edges(a, b)``; edges may repeat or be loops."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(both.where("a <> b").distinct())
    rounds = []
    while not left.isEmpty():
        parent = stored(left.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parent = parent.join(up, "parent").select("node", F.col("above").alias("parent"))
        parent = stored(parent)
        rounds.append(parent)
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        left = stored(left.join(of_a, "a").join(of_b, "b").where("x <> y").select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not rounds:
        return edges.where("false").select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].withColumnRenamed("parent", "component")
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        found = found.join(step, "component", "left").select(
            "node", F.coalesce("next", "component").alias("component"))
    return found
