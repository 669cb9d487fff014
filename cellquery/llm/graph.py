"""Connected components by minimum labels with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquery.llm.scratch import save


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (longs ``a, b``): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's label; rounds grow
    with the logarithm of the longest path. Labels are written out each round.
    """
    edges = edges.select("a", "b").filter("a != b")
    both = save(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = save(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("component")
        )
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("label")
        )
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("jumped"))
        step = save(
            lower.join(above, "label").select(
                "node", F.col("jumped").alias("label"), (F.col("jumped") < F.col("component")).alias("moved")
            )
        )
        labels = step.select("node", F.col("label").alias("component"))
        if step.filter("moved").isEmpty():
            return labels
