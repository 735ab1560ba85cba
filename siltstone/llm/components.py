"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import join_hot, settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each end of ``edges`` (a, b); component is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label's
    own label, so that chains halve; it ends when no label changes.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count(F.lit(1)).alias("often")), "labels")
    while True:
        near = join_hot(both, labels, ["b"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("b") == F.col("a")).select("b", F.least("component", "near").alias("component"), F.col("component").alias("before"), F.col("often").alias("degree"))
        low = settle(low, "lower_labels")
        own = low.select(F.col("b").alias("component"), F.col("component").alias("above"))
        sizes = low.groupBy("component").agg(F.count(F.lit(1)).alias("often"))
        up = settle(sizes.join(own, "component"), "labels_of_labels")
        new = join_hot(low, up, ["component"]).select("b", F.col("above").alias("component"), F.col("degree").alias("often"), (F.col("above") != F.col("before")).alias("changed"))
        new = settle(new, "labels")
        labels = new.drop("changed")
        if not new.where("changed").limit(1).count():
            return labels.select(F.col("b").alias("id"), "component")
