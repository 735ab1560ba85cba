"""Connected components of an edge table, by rounds of smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.checkpoints import cut
from siltstone.operators.joins import join_by


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of each end of ``edges`` (a, b); component is the smallest id that can be reached.

    A round takes the smallest label among neighbours and then that label's
    own label, so chains halve; the lineage is cut in each round.  An id or a label
    that many rows share is not gathered.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = join_by(both, labels.withColumnRenamed("id", "b"), ["b"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        low = cut(low)
        up = low.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = cut(join_by(low, up, ["component"]).select("id", F.col("above").alias("component"), (F.col("above") != F.col("before")).alias("changed")))
        labels = new.select("id", "component")
        if not new.where("changed").limit(1).count():
            return labels
