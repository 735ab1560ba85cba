"""The event queries as streams: a folder of Parquet files read to its end with ``availableNow``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.checkpoints import shared_folder
from siltstone.registry import query
from siltstone.sources.tables import table


def event_stream(spark: SparkSession, folder: str, late: str | None = "10 minutes") -> DataFrame:
    """Events as a stream, with a watermark if ``late`` is given; ``ts`` has to be a timestamp with time zone for one."""
    schema = table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet")
    timed = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if late else timed


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream to the end of its input; its results as a table in the shared folder."""
    spark, at = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own part
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def sessions(spark: SparkSession, folder: str, gap: str) -> DataFrame:
    """Sessions of users (w, user_id, n) in append mode: each is told once, when the watermark has passed its end.

    After the input has been read, the same query goes on with one event of
    no user far ahead, which moves the watermark past all others.  That
    event's own session stays open and is never told.
    """
    at = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    schema = events.schema
    events.limit(0).write.parquet(f"{at}/end")  # makes the folder that the stream watches
    files = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet")
    every = files.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").union(spark.readStream.schema(schema).parquet(f"{at}/end"))
    counted = every.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    run = lambda: counted.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    run()
    last = spark.range(1).select(F.lit("9000-01-01").cast("timestamp").alias("ts"), F.lit(None).cast(schema["user_id"].dataType).alias("user_id"))
    last.write.mode("append").parquet(f"{at}/end")
    run()
    return spark.read.schema(counted.schema).parquet(f"{at}/out")


def latest(results: DataFrame, *keys: str) -> DataFrame:
    """Of updates, the last of each key."""
    others = [c for c in results.columns if c not in (*keys, "batch")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], at: str) -> list[tuple[str, str]]:
    """Publish each batch to all sinks; one that fails does not keep the others from it, and is told at the end."""
    failures: list[tuple[str, str]] = []

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for name, sink in sinks.items():
            try:
                sink(held)
            except Exception as error:  # noqa: BLE001  a sink may fail in any way
                failures.append((name, str(error)))
        held.unpersist()

    stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return failures


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) > 0 AS some FROM events GROUP BY event_type")
def stream_event_counters(spark, folder):
    counted = event_stream(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return latest(drained(counted, "update"), "event_type").withColumn("some", F.col("n") > 0)


@query("SELECT floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, folder):
    counted = event_stream(spark, folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = latest(drained(counted.select(F.col("w.start").alias("start"), "event_type", "n"), "update"), "start", "event_type")
    return out.select(F.unix_timestamp("start").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, folder):
    # a session ends after half an hour without an event; an addition to the batch queries
    return sessions(spark, folder, "30 minutes").select("user_id", F.unix_timestamp("w.start").alias("start"), "n")
