"""Tables that outlive a job: written to the folder all executors share, and read back."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at once.
ARROW_BYTES = 8 << 20
#: A key is hot if more than a HOT-th of all rows have it, and over LEAST.
HOT, LEAST = 4096, 4096


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a folder in the warehouse, which is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python workers by ARROW_BYTES at once: batches of long rows (texts, sets) are held by the JVM and the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again, and let Spark drop the shuffle files of what is done."""
    for df in tables:
        spark, paths = df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()}
        for at in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def join_hot(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in column ``often`` how many of the rows have it.

    The hot keys, fewer than HOT whatever the size, go to all tasks; the others
    are joined by hash.  So no task gets more than its share and one key of
    less than a HOT-th of the rows.
    """
    total, top = table.agg(F.sum("often"), F.max("often")).first()
    bound = max((total or 0) // HOT, LEAST)
    if (top or 0) <= bound:
        return rows.join(table.drop("often").hint("merge"), on)
    hot = F.broadcast(table.where(F.col("often") > bound).drop("often"))
    rest = rows.join(F.broadcast(table.where(F.col("often") > bound).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table.where(F.col("often") <= bound).drop("often").hint("merge"), on))
