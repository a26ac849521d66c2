"""Path distances on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.bounds import BROADCAST_BYTES, BROADCAST_ROWS, size_in_bytes
from caseloom.plans.lineage import cut, stored


def _links(edges: DataFrame, sign: int = 1) -> DataFrame:
    """A stored copy of the edges. Parallel edges stay: a round takes the smallest of all offers anyway."""
    return stored(edges.select("src", "dst", (F.col("weight").cast("double") * sign).alias("w")))


def _from(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """The links that leave the frontier (a written table with ``src``), without a shuffle of the links while it is small."""
    rows, size = size_in_bytes(frontier)
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return links.join(F.broadcast(frontier) if small else frontier, "src")


def path_distances(edges: DataFrame, source: str, longest: bool = False, max_rounds: int | None = None) -> DataFrame:
    """Single-source shortest (or, on acyclic graphs, longest) distances over
    ``src, dst, weight``: ``node, distance``.

    Only nodes whose distance improved last round are relaxed; every round is
    checkpointed.  A path of as many edges as nodes are known passes a node twice,
    so an improvement by one means a cycle that keeps improving and is an error.
    """
    sign = -1 if longest else 1
    links = _links(edges, sign)
    spark = edges.sparkSession
    known = changed = spark.createDataFrame([(source, 0.0)], "node string, distance double")
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        offers = _from(changed.withColumnRenamed("node", "src"), links).groupBy(F.col("dst").alias("node")).agg(
            F.min(F.col("distance") + F.col("w")).alias("_new"))
        merged = cut(known.join(offers, "node", "full").select(
            "node", F.least("distance", "_new").alias("distance"),
            (F.col("_new").isNotNull() & (F.col("distance").isNull() | (F.col("_new") < F.col("distance")))).alias("_moved")))
        known = merged.select("node", "distance")
        changed = merged.where("_moved").select("node", "distance")
        moved, nodes = merged.agg(F.count_if("_moved"), F.count(F.lit(1))).first()
        if not moved:
            return known.select("node", (F.col("distance") * sign).alias("distance"))
        if rounds >= nodes:
            break
    raise ValueError("distances keep improving: the graph has a cycle of negative (or, for longest, positive) weight")


def all_pairs_distances(edges: DataFrame) -> DataFrame:
    """Shortest distances between all connected pairs by repeated min-plus self
    joins (doubling the path length): ``src, dst, distance``."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    loops = nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0.0).alias("distance"))
    paths = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("distance")).unionByName(loops)
                .groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    count = max(nodes.count(), 2)
    for _ in range((count - 1).bit_length()):
        first = paths.select("src", F.col("dst").alias("via"), F.col("distance").alias("_a"))
        second = paths.select(F.col("src").alias("via"), "dst", F.col("distance").alias("_b"))
        paths = cut(first.join(second, "via").groupBy("src", "dst").agg(F.min(F.col("_a") + F.col("_b")).alias("distance")))
    return paths


def distances_from(edges: DataFrame, sources: DataFrame, within: float | None = None) -> DataFrame:
    """Shortest distances from every source of a table (``source``) to all nodes it reaches, at most ``within``:
    ``source, node, distance``, the source itself at 0.

    The frontier is keyed by (source, node): a round relaxes the pairs that improved in the last one only, and the rounds
    are as many as the edges of the longest shortest path. Nodes that no edge leaves are not relaxed, if they are few
    enough to be told by a broadcast. Weights must not be negative.
    """
    links = _links(edges)
    if not links.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    ends = stored(links.select(F.col("dst").alias("_end")).where("dst IS NOT NULL").distinct().join(
        links.select(F.col("src").alias("_end")).distinct(), "_end", "left_anti"))
    rows, size = size_in_bytes(ends)
    onward = F.lit(True)
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        links = links.join(F.broadcast(ends), F.col("dst") == F.col("_end"), "left")
        onward = F.col("_end").isNull()
    links = links.select("src", "dst", "w", onward.alias("_on"))
    known = stored(sources.select(F.col("source").cast("string").alias("source")).where("source IS NOT NULL").distinct().select(
        "source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("_moved")))
    while True:
        frontier = known.where("_moved").select("source", F.col("node").alias("src"), "distance")
        offers = _from(frontier, links).select("source", F.col("dst").alias("node"), "_on", (F.col("distance") + F.col("w")).alias("_new"))
        offers = (offers if within is None else offers.where(F.col("_new") <= within)).groupBy("source", "node").agg(
            F.min("_new").alias("_new"), F.first("_on").alias("_on"))
        better = F.col("_new").isNotNull() & (F.col("distance").isNull() | (F.col("_new") < F.col("distance")))
        known = stored(known.drop("_moved").join(offers, ["source", "node"], "full").select(
            "source", "node", F.least("distance", "_new").alias("distance"),
            (better & F.col("_on")).alias("_moved")))
        if known.where("_moved").isEmpty():
            return known.drop("_moved")
