"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node reachable.

    Labels move along edges by minimum and then along the labels before the round, which halves
    long chains. Minimums are pre-aggregated in each task, and a node with many edges has one label
    row, so Spark can split its edges over tasks. Every round is one stored table, whose rows also
    hold the label before, so that the end is seen in it alone.
    """
    both = edges.where(F.col("a") != F.col("b"))
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("label"))
    nearest = both.select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = materialize(nearest.unionByName(loops).groupBy("node").agg(F.min("label").alias("label")))
    while True:
        of_neighbour = labels.select(F.col("node").alias("b"), F.col("label").alias("label"))
        seen = both.join(of_neighbour, "b").select(F.col("a").alias("node"), "label")
        own = labels.withColumn("old", F.col("label"))
        lowered = own.unionByName(seen, allowMissingColumns=True).groupBy("node").agg(
            F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = materialize(lowered.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old"
        ))
        labels = jumped.drop("old")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels
