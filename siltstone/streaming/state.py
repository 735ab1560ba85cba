"""State machines as streams: rows wait until the watermark has passed them, then are taken in order; timers wake a key when something is due.

So the order in which rows arrive, and how they fall into batches, changes
nothing, and a stream tells what the fold over the same rows tells.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.checkpoints import shared_folder
from siltstone.operators.machines import Machine

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """A machine's state for each key, and its rows that the watermark has not yet passed.

    ``ttl_ms``: a key without rows for so long (processing time, 0 for never) is forgotten.
    """

    def __init__(self, key: str, machine: Machine, ttl_ms: int = 0) -> None:
        self.key, self.machine, self.ttl_ms = key, machine, ttl_ms
        self.rows = StructType.fromDDL(machine.columns)  # schemas are read on the driver
        self.names, self.out = self.rows.names, [key, *StructType.fromDDL(machine.out).names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl_ms or None
        self.state = handle.getValueState("state", StructType([StructField("told", StringType())]), ttl)
        self.held = handle.getListState("held", self.rows, ttl)
        self.wakes = handle.getValueState("wakes", StructType([StructField("at", LongType())]), ttl)
        self.handle = handle

    def _wake(self, at: int | None) -> None:
        """One timer at a time: the earliest, just after a row or a due time can no longer be preceded."""
        set_at = self.wakes.get()[0] if self.wakes.exists() else None
        if at is not None and (set_at is None or at + 1 < set_at):
            if set_at is not None:
                self.handle.deleteTimer(set_at)
            self.handle.registerTimer(at + 1)
            self.wakes.update((at + 1,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [tuple(row[n] for n in self.names) for row in rows]
        if new:
            self.held.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready, rest = sorted((r for r in every if r[0] < passed), key=lambda r: r[:2]), [r for r in every if r[0] >= passed]
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start
        told: list[tuple] = []
        for row in ready:
            state, more = self.machine.taken(state, dict(zip(self.names, row, strict=True)))
            told += more
        state, more = self.machine.waits(state, passed - 1)
        told += more
        self.state.update((json.dumps(state),))
        if ready:
            self.held.clear()
            if rest:
                self.held.appendList(rest)
        self.wakes.clear()
        self._wake(min([r[0] for r in rest] + [at for at in (self.machine.due(state),) if at is not None], default=None))
        return iter([Row(**dict(zip(self.out, (key[0], *x), strict=True))) for x in told])

    def close(self) -> None:
        pass


def run(stream: DataFrame, key: str, machine: Machine, late: str = "10 minutes", ttl_ms: int = 0) -> DataFrame:
    """What ``machine`` tells of a stream of rows (key, at in ms, place, and its columns), in append mode; needs the RocksDB state store."""
    kind = dict(stream.dtypes)[key]
    timed = stream.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)
    return timed.groupBy(key).transformWithState(Ordered(key, machine, ttl_ms), StructType.fromDDL(f"`{key}` {kind}, {machine.out}"), "Append", "EventTime")


def settled(spark: SparkSession, source: Callable[[SparkSession], DataFrame], key: str, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """Run a machine over all that ``source`` gives (a stream of key, at, place and the machine's columns) to its end: a table of all it tells.

    After the input has been read, the same query goes on with a row of no
    key far ahead, which moves the watermark past all others; that row itself waits for ever.
    """
    at = f"{shared_folder(spark)}/machine-{uuid.uuid4().hex}"
    names = [x.split()[0] for x in machine.columns.split(", ")]
    rows = source(spark).select(key, *names)
    kinds = dict(rows.dtypes)
    spark.createDataFrame([], rows.schema).write.parquet(f"{at}/end")  # makes the folder that the stream watches
    every = rows.union(spark.readStream.schema(rows.schema).parquet(f"{at}/end"))
    told = run(every, key, machine, late)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def go() -> None:
        told.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    try:
        go()
        far = [F.lit(253_000_000_000_000).cast("long").alias("at") if n == "at" else F.lit(None).cast(kinds[n]).alias(n) for n in names]
        spark.range(1).select(F.lit(None).cast(kinds[key]).alias(key), *far).write.mode("append").parquet(f"{at}/end")
        go()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(told.schema).parquet(f"{at}/out")
