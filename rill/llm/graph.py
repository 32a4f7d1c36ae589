"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import discard, hot_keys, looked_up, stored

def contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components as edges (a, b), in proportion to the nodes: of each a one edge to its least b, and one from that to
    each other b, every pair once. An a must have few different b (here at most the bands, or the blocks of a cluster)."""
    low = F.min("b").over(W.partitionBy("a"))
    each = edges.select("a", "b").withColumn("low", low)
    own = each.select("a", F.col("low").alias("b")).distinct()
    others = each.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    return own.union(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of edges (a, b), and the smallest node of its component.

    A round: each node takes the least label around it, then the label that this one has. What a label has seen doubles
    each round, so rounds grow with the logarithm of the longest path. Each round's labels are a stored table. Minima go
    before the shuffle, and rows that look up a hub or a common label are dealt in many ways, so neither gathers its neighbours in a task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = hot_keys(both, "b", 2 * edges.count())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = stored(first.select("node", F.least("node", "low").alias("label"), F.lit(True).alias("moved")), "labels")
    nodes = labels.count()
    while labels.where("moved").limit(1).count():
        of = labels.select("node", "label")
        around = looked_up(both, "b", of.withColumnRenamed("node", "b"), hubs, "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = of.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        low = stored(low, "low") if nodes > common.HOT_ROWS else low
        known = of.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = looked_up(low, "low", known, hot_keys(low, "low", nodes), "node").select("node", F.least("low", "further").alias("new"), "label")
        new = new.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved"))
        old, labels = labels, stored(new, "labels")
        discard(old, *([low] if nodes > common.HOT_ROWS else []))
    return labels.select("node", "label")
