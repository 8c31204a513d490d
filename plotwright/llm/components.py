"""Connected components of an edge table, by labels that shrink and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b); root is the smallest node reachable.

    A round gives each node the smallest label around it and then the label of that label, so a chain shortens to half
    or less. Every step aggregates before it shuffles and joins on a column that AQE may split; rounds are cut by
    checkpoints, and only the count of changes comes to the driver.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("root", "m").alias("low"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = durable(lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("root"), "was"))
        if new.where("root != was").limit(1).count() == 0:
            return new.select("node", "root")
        labels = new.select("node", "root")
