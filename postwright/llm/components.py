"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_salted


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of the edges (a, b); comp is the smallest node of its component.

    Each round points every neighbour at the smallest one seen, first upwards (large star), then downwards (small
    star), until the edges are stars around the smallest nodes. Edges stay distributed, each round is cut by a
    checkpoint, and the number of edges never grows. Null ends and self loops are dropped.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, size = None, e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        met = join_salted(both, least, ["u"], "n", total=2 * size).filter("v > u AND v <> m")
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = join_salted(large, least, ["u"], "n", total=size)
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct(), used=[e])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp")))
