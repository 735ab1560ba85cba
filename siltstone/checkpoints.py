"""Cutting a lineage in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a folder in the warehouse, which is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its rows in the shared folder, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_together(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` cut where those with an equal first column of ``order`` lie together and in order.

    Spark knows so of what is read back, and what is found by that column moves
    and sorts nothing; of a plan that adapts itself it would not be told.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    adapts = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(rows.repartition(int(conf.get("spark.sql.shuffle.partitions")), order[0]).sortWithinPartitions(*order))
    finally:
        conf.set(name, adapts)
