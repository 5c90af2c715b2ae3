"""Connected components of an edge table by alternating stars.

Large-star joins every larger neighbour of a node to the node's least
neighbour, small-star the node and its smaller neighbours; both keep
components and each round shortens all paths, so the number of rounds grows
with the logarithm of the longest path. Each round is written to the shared
folder; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v), u > v."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        linked = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long, in any order, loops and repeats allowed); root is the least node reachable."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    # a checkpoint would keep constraints of the plan behind it, under which the optimiser may fail to find u
    edges = stored(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        edges = checkpointed(_star(_star(edges, large=True), large=False))
        row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if (row["n"], row["h"]) == state or not row["n"]:
            break
        state = (row["n"], row["h"])
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
