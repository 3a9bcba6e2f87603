"""Connected components of an edge table by minimum labels with pointer jumping.

Edges are joined with labels (joins that Spark can split when a node is hot) and
labels are combined with partial aggregation, so no node's edges meet in one task.
Every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges(a, b); component is the smallest node reachable."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        step = step.join(jump, "next", "left").select("node", F.col("component").alias("before"), F.least("next", "beyond").alias("component"))
        step = stored(step, "labels")
        labels = step.select("node", "component")
        if step.filter("component <> before").isEmpty():
            return labels
