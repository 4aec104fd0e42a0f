"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the undirected edges (a, b).

    Returns (node, component) for every node that has an edge. Each round takes the
    smallest label among neighbours and then the label's own label; rounds write their
    labels to the shared folder and end when none changes. A hub's neighbours are combined
    before the shuffle, and the join on a hub can be split.
    """
    both = edges.select("a", "b").where("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b"))
    both = materialize(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(seen, labels.node == seen.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("near"))
        own = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = lower.join(own, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component"))
        after = materialize(after, "labels")
        labels = after.select("node", "component")
        if after.where("old != component").isEmpty():
            return labels
