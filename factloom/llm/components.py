"""Connected components of a link table by label propagation with pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of a link, ``label`` being the smallest node that links reach from it.

    In every round a node takes the smallest label among its own, its neighbours' and that of the node its label names; rounds end when no label
    changes. Each round is a table of its own, so lineage does not grow. Labels are combined inside the tasks before they are shuffled, so a node
    with very many links is no large group.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
                   .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
                   .select("e.u", "e.v").distinct(), "links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("low")))
        lower = labels.join(near, F.col("node") == F.col("u"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        moved = written(lower.join(jump, F.col("label") == F.col("__node"), "left").select("node", "old", F.least("label", "__label").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels
