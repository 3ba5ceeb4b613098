"""Connected components of an edge table, by repeated joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.llm.common import write_table


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    labels travel twice as far each round.  Every round is written, so a lost executor re-reads files.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_table(both, f"{path}/edges")
    labels = write_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{path}/labels-0")
    at = 0
    while True:
        at += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        moved = write_table(moved, f"{path}/moved-{at}")
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = moved.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was")
        after = write_table(after, f"{path}/labels-{at}")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
