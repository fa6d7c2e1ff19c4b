"""Connected components of an edge table as DataFrame joins; no ids reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, table_path

#: Rounds after which a graph is declared broken; labels at least double their reach in each.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then jumps to the label's own label, so
    paths shrink exponentially. Partial aggregation and Spark's splitting of skewed joins keep a hub's edges
    from meeting in one task.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.withColumnRenamed("b", "node").join(labels, "node").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        best = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        moved = best.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("root", "label")).alias("component"))
        after = materialise(moved, "labels")
        changed = after.where("was <> component").limit(1).count()
        old, labels = labels, after.select("node", "component")
        remove(spark, table_path(old))
        if not changed:
            remove(spark, table_path(both))
            return labels
    raise RuntimeError("components did not settle")
