"""Connected components of an undirected graph given by edges.

Method: alternating large-star and small-star rounds (each edge is re-hung to the smallest neighbour), which end in
stars around each component's smallest node after O(log^2 n) rounds. A round is two aggregates and two joins on node
ids; nothing is collected, hubs are hot join keys left to adaptive skew joins. Loops and repeated edges change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.scratch import stage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the component's smallest node) of every node with an edge."""
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    alone = e.filter("u = v").select("u")
    e = e.filter("u <> v")
    last = None
    while (now := _state(e)) != last:
        last = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stage(small.filter("u <> v").distinct(), "edges")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
