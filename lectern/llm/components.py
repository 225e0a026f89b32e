"""Connected components of a large sparse graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest node around it: the larger ones (large) or the others."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    kept = seen.filter("b > a") if large else seen
    # on two keys, both sides are dealt anew, and Spark can split the rows of a node with many neighbours
    same = F.col("a").bitwiseAND(0xFFFF)
    linked = kept.withColumn("same", same).join(least.withColumn("same", same), ["same", "a"]).select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        linked = linked.unionByName(least.select("a", F.col("low").alias("b")))
    return linked.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node that can be reached.

    Each step makes at most as many edges as it read and is written to the shared folder; the driver sees
    one checksum of it. Self-links and nulls are left out; an empty table gives an empty result.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total[0] == 0 or total == before:
            break
        before = total
        edges = durable(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
