"""Connected components by contraction, for groups of alike rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Nodes with more than one in so many edges are split.
HOT_SHARE = 200


def relabelled(edges: DataFrame, by: str, labels: DataFrame, degrees: DataFrame, n_edges: int) -> DataFrame:
    """edges with column `by` replaced by its label. labels: (node, label); degrees: (node, degree).

    The edges of a node with many of them go to several tasks, by the other columns' hash, and its label to each.
    There are at most HOT_SHARE such nodes at one end, twice that at both, and their ids alone come to the driver.
    """
    most = max(1000, n_edges // HOT_SHARE)
    hot = [r.node for r in degrees.filter(F.col("degree") > most).orderBy(F.desc("degree")).limit(2 * HOT_SHARE).collect()]
    others = [c for c in edges.columns if c != by]
    if not hot:
        return edges.join(labels.select(F.col("node").alias(by), F.col("label").alias("cc__new")), by).drop(by).withColumnRenamed("cc__new", by).select(*edges.columns)
    left = edges.withColumn("cc__salt", F.when(F.col(by).isin(hot), F.pmod(F.xxhash64(*others), F.lit(HOT_SHARE))).otherwise(0).cast("int"))
    every = F.sequence(F.lit(0), F.lit(HOT_SHARE - 1))
    right = labels.select(F.col("node").alias(by), F.col("label").alias("cc__new"), F.explode(F.when(F.col("node").isin(hot), every).otherwise(F.array(F.lit(0)))).alias("cc__salt"))
    return left.join(right, [by, "cc__salt"]).drop(by, "cc__salt").withColumnRenamed("cc__new", by).select(*edges.columns)


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): component is the smallest node of those connected.

    Each round every node points to the one of its closed neighbourhood that is least in a random order of the round, edges
    are drawn between those pointed to, and loops and repeats go, so edges fall by a constant share on average. Then the
    rounds' labels are followed back. Null ends and loops are dropped; a node stands in it only if it has an edge.
    """
    e = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    for i in range(most_rounds):
        n = e.count()
        if not n:
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(i), F.col(c)), F.col(c).alias("node"))  # noqa: E731, B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("x"), F.count("*").alias("degree")))
        own = F.struct(F.xxhash64(F.lit(i), F.col("node")), F.col("node").alias("node"))
        labels = near.select("node", F.least("x", own)["node"].alias("label"))
        degrees = near.select("node", "degree")
        moved = relabelled(relabelled(e, "a", labels, degrees, n), "b", labels, degrees, n)
        e = scratch.write(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rounds.append(labels)
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0]
    for labels in rounds[1:]:
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        sizes = found.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("degree"))
        moved = relabelled(found.select("node", "label"), "label", ends.select(F.col("label").alias("node"), F.col("onward").alias("label")), sizes, found.count())
        gone = found.join(ends.select("label"), "label", "left_anti").select("node", "label")
        found = scratch.write(moved.unionByName(gone))
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    sizes = found.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("degree"))
    return relabelled(found, "label", least.select(F.col("label").alias("node"), F.col("component").alias("label")), sizes, found.count()).withColumnRenamed("label", "component")
