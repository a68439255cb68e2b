"""Connected components of an edge table, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (v, label), label the least vertex of v's component.

    Each round takes the least label among neighbours (a partial aggregation,
    so a hub leaves each task as one row), then jumps to the label's own label;
    rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    labels = written(both.groupBy(F.col("src").alias("v")).agg(F.least(F.min("dst"), F.col("src")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("top"))
        new = written(lower.join(up, "label").select("v", "old", F.least("label", "top").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels
