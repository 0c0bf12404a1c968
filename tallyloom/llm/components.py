"""Connected components of a graph given as rows of edges.

Alternating large-star and small-star steps hang every node on the smallest one it can see,
until nothing changes; each step is one aggregate and one join on the node, written to the
shared folder, so that nothing of the graph passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b; each node's neighbours are hung on its smallest one."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = ways.groupBy("a").agg(F.min("b").alias("low"))
    low = F.least("low", "a") if large else F.col("low")
    joined = ways.join(least, "a").withColumn("low", low)
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    hung = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, repeats and loops allowed -> (node, component), component the smallest node reachable.

    Only nodes that have an edge to another one are returned, the smallest of each component included.
    """
    links = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = None
    while (now := links.agg(state.alias("s")).first()["s"]) != before:
        before = now
        links = staged(_star(_star(links, True), False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
