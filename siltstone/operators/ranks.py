"""Numbers of rows in an order, without taking a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.checkpoints import cut


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "n") -> DataFrame:
    """``rows`` with their number from 1 in ``order`` among those with equal ``by``.

    Rows are spread by ranges of (by, order), cut there, and numbered within
    each range; what lies in earlier ranges is added.  Only the first key of a
    range can have begun before it, so there are fewer offsets than ranges,
    and they are broadcast.  Rows that are equal in ``by`` and ``order`` are
    numbered in any order.
    """
    own = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_before", F.sum("_size").over(earlier)).where("_before is not null")
    offsets = offsets.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_by_{c}") for c in by], "_before")
    met = F.col("_range") == F.col("_at")
    for c in by:
        met &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)).cast("long")
    held = own.withColumn("_place", place).join(F.broadcast(offsets), met, "left")
    return held.select(*rows.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(out))
