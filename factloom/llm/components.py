"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for each node that has a link.

    Runs until nothing changes, however long the chains are. Nulls and links of a node to itself don't count; repeated links count once;
    no links give an empty result. Nothing is collected but a sum for each round.
    """
    both = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    n = links.count()
    edges, before = materialize(edges, "links", rows=n), None
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    while True:
        now = mark(edges)
        if now == before or not now[0]:
            break
        before = now
        around = edges.unionByName(both(edges))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.where("u > v").distinct(), "links", rows=now[0])
        discard(old)
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).groupBy("node").agg(F.min("component").alias("component"))
