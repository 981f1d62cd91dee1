"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round every node takes the smallest label among its own, its neighbours' and that of the
    node its label names, so labels run over doubled distances.  Labels are written to the shared
    folder after each round, which ends lineage; nothing but a count comes to the driver.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = stage(spark, both, "component-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
    labels = stage(spark, labels, "component-labels")
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        nearer = labels.join(offered, "node").select("node", F.least("root", "offer").alias("step"), F.col("root").alias("before"))
        over = labels.select(F.col("node").alias("step"), F.col("root").alias("over"))
        after = nearer.join(over, "step").select("node", F.least("step", "over").alias("root"), (F.least("step", "over") != F.col("before")).alias("moved"))
        after = stage(spark, after, "component-labels")
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
