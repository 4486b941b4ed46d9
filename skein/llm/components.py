"""Connected components over an edge table: least label of the neighbours, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (a, b); the component is its smallest node. Each round is written out."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        stepped = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        nxt = materialise(stepped.join(up, "c").select("node", F.least("c", "up").alias("component"), "old"), "cc-labels")
        labels = nxt.select("node", "component")
        if nxt.where("component != old").isEmpty():
            return labels
