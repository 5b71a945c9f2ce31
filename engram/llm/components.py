"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that is reachable. Each round takes the smallest label
    among the neighbours and then the label of that label, so distances double; the minimum
    is combined before the shuffle, so a node with many edges is no burden."""
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = materialize(spark, both.union(both.select(F.col("v"), F.col("u"))).distinct(), "cc-edges")
    labels = materialize(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("of")), "v").groupBy("u").agg(F.min("of").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        moved = step.join(up, "new", "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new"))
        moved = materialize(spark, moved, "cc-labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new != label").isEmpty():
            return labels
