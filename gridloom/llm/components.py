"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any type that has an order: (node, label) with label the least node of its component.

    Each round takes the least label among neighbours (a sum by key that combines before the
    shuffle) and then the label's own label, so the rounds grow with the logarithm of the longest
    path. Labels are written each round: lineage stays short. No edge: no row.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.selectExpr("node as to", "label as onward")
        new = materialise(step.join(jump, "to").select("node", F.least("to", "onward").alias("label"), (F.least("to", "onward") != F.col("was")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_scratch(new.sparkSession, labels)
        labels = new.select("node", "label")
        if not moved:
            drop_scratch(new.sparkSession, both)
            return labels
