"""Tables by name under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all tasks: narrow ones of which much is made, which a small file would leave to one."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as a timestamp with time zone, which watermarks and epoch functions need."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
