"""Run telemetry: windows over ordered samples and events, and the few folds that need state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.machines import fold, verdict

COUNTERS = ("queue_size", "knowledge_size", "discovered", "processed")
#: Stretches of a trailing window by which events are spread.
STRETCH = 64


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int, out: str = "n") -> DataFrame:
    """How many events of a key lie in the time up to each event.

    A key's events are spread by stretches of time, and those in the last
    ``seconds`` of a stretch are copied to the next one, so a hot key does not
    lie in one task.
    """
    span = seconds * 1_000_000
    at = F.unix_micros(ts)
    stretch = lambda t: F.floor(t / F.lit(STRETCH * span))
    spread = events.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(at), stretch(at + span)))))
    w = Window.partitionBy(key, "_stretch").orderBy(at).rangeBetween(-span, 0)
    return spread.withColumn(out, F.count(F.lit(1)).over(w)).where(F.col("_stretch").eqNullSafe(stretch(at))).drop("_stretch")


def trailing_mean(samples: DataFrame, key: str, at: str, value: str, span: int, out: str = "mean") -> DataFrame:
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0)
    return samples.withColumn(out, F.avg(value).over(w))


def over_cap(events: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Marks events that come when ``limit`` others came within the hour, or sooner than 3600 / limit seconds after the last."""
    own = trailing_count(events, key, ts, 3600, "in_hour")
    before = F.lag(F.unix_micros(ts)).over(Window.partitionBy(key).orderBy(F.unix_micros(ts)))
    gap = (F.unix_micros(ts) - before) / 1_000_000
    return own.withColumn("over", (F.col("in_hour") > limit) | F.coalesce(gap < 3600 / limit, F.lit(False)))


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Gaps and islands: each stretch of equal values in order, with its length."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    told = rows.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(key, "run", value).agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*order)).alias("first")).drop("first")


def last_n(rows: DataFrame, order: list[Column], n: int, by: str | None = None, kinds: tuple[str, list[str]] | None = None) -> DataFrame:
    """The newest ``n`` rows, of some kinds only if given."""
    if kinds:
        rows = rows.where(F.col(kinds[0]).isin(*kinds[1]))
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def running_max(rows: DataFrame, key: str, order: list[str], value: str, out: str = "peak") -> DataFrame:
    return rows.withColumn(out, F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def throughput(done: Column, elapsed_ms: Column) -> Column:
    """Per second; 0 while no time has passed."""
    return F.when(elapsed_ms > 0, done * 1000.0 / elapsed_ms).otherwise(F.lit(0.0))


def progress(visited: Column, discovered: Column) -> Column:
    """Whole per cent, at most 100; 0 while nothing is known."""
    return F.when(discovered > 0, F.least(F.lit(100), F.floor(visited * 100.0 / discovered + 0.5))).otherwise(F.lit(0)).cast("int")


def build_progress(completed: Column, running: Column, total: Column) -> Column:
    """Per cent of phases; one that runs counts a quarter, and 99 is the most before the end."""
    return F.least(F.lit(99), F.floor((completed + 0.25 * running) * 100.0 / total + 0.5)).cast("int")


def remaining_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    return F.when(done > 0, F.floor(elapsed_ms * (total - done) / done)).cast("long")


def job_counters(events: DataFrame, by: str) -> DataFrame:
    """Counters of jobs from their events (type): discovered, visited, failed, and what is pending, not below 0."""
    own = events.groupBy(by).agg(*[F.count_if(F.col("type") == kind).alias(name) for kind, name in (("PageDiscovered", "discovered"), ("PageVisited", "visited"), ("PageFailed", "failed"))])
    return own.withColumn("pending", F.greatest(F.col("discovered") - F.col("visited") - F.col("failed"), F.lit(0)))


def stability(samples: DataFrame, key: str, order: str, tolerance: float = 0.05) -> DataFrame:
    """Whether each sample equals the one before it, memory within a tolerance; and for how many samples on end it has been so."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lit(True)
    for name in COUNTERS:
        same &= F.col(name) == F.lag(name).over(w)
    memory = F.lag("memory_rss").over(w)
    same &= F.abs(F.col("memory_rss") - memory) <= tolerance * memory
    own = samples.withColumn("stable", F.coalesce(same, F.lit(False)))
    known = F.coalesce(F.col("knowledge_size") == F.lag("knowledge_size").over(w), F.lit(False))
    own = own.withColumn("stagnant", known)
    for flag in ("stable", "stagnant"):
        own = own.withColumn("_r", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        counted = F.sum(F.when(F.col(flag), 1).otherwise(0)).over(Window.partitionBy(key, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        own = own.withColumn(f"{flag}_windows", counted).drop("_r")
    return own


def folded(rows: DataFrame, key: str, order: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, object]], out: str, kind: pa.DataType, name: str) -> DataFrame:
    """key, order and what ``step`` (state, row) yields for each row of a key, taken in order.

    Keys are spread by hash and sorted within their partitions, where Spark
    spills; a task holds one batch of rows and the state of the key at hand.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, here, state = False, None, None
        for batch in batches:
            told = []
            for row in batch.to_pylist():
                if not begun or row[key] != here:
                    begun, here, state = True, row[key], start()
                state, value = step(state, row)
                told.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(told, kind)], [key, order, out])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {out} {name}")


def verdicts(samples: DataFrame, key: str, order: str, required: int = 3) -> DataFrame:
    """The decision after each sample: continue, pause_discovery, complete or exhausted, as machines.verdict() says; ``order`` is a whole number."""
    own = samples.withColumns({"at": F.col(order).cast("long"), "place": F.lit(0).cast("long")})
    told = fold(own, key, verdict(required))
    return told.select(key, F.col("at").cast(dict(samples.dtypes)[order]).alias(order), "verdict")


def cooldowns(events: DataFrame, key: str, ts: str, limit: int = 10, window_s: int = 30, rest_s: float = 45.0) -> DataFrame:
    """Starts of rests: ``limit`` events within the window start one, unless one is under way.

    The events of one key are folded in order of time; only the start of the
    last rest is held.
    """
    counted = trailing_count(events.select(key, ts), key, ts, window_s).where(F.col("n") >= limit).select(key, F.unix_micros(ts).alias("start_us")).distinct()

    def step(until: float, row: dict) -> tuple[float, bool]:
        at = row["start_us"]
        return (at + rest_s * 1e6, True) if at >= until else (until, False)

    return folded(counted, key, "start_us", lambda: float("-inf"), step, "starts", pa.bool_(), "boolean").where("starts").drop("starts")


def concurrency(outcomes: DataFrame, key: str, order: str, base: int, adaptive: bool = True) -> DataFrame:
    """Workers after each outcome (ok, limited, in_cooldown): halved (or one less) when limited, one more after three successes.

    The outcomes of one run are folded in order.
    """

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], int]:
        workers, successes = state
        if row["outcome"] == "limited":
            workers, successes = max(1, workers // 2 if adaptive else workers - 1), 0
        elif row["outcome"] == "ok":
            successes += 1
            if adaptive and successes >= 3 and not row["in_cooldown"]:
                workers = min(base, workers + 1)
        return (workers, successes), workers

    return folded(outcomes.select(key, order, "outcome", "in_cooldown"), key, order, lambda: (base, 0), step, "workers", pa.int32(), "int")


def due_retries(pending: DataFrame, now_ms: int) -> DataFrame:
    """Retries (url, next_attempt_at, attempt, max_attempts) that are due, first come first; and those that have used up their tries."""
    state = F.when(F.col("attempt") >= F.col("max_attempts"), F.lit("failed")).when(F.col("next_attempt_at") <= now_ms, F.lit("due")).otherwise(F.lit("waiting"))
    return pending.withColumn("state", state)


def phase_to_resume(checkpoints: DataFrame, phases: list[str]) -> DataFrame:
    """Of each job the phase to go on with: the first that runs, failed or is paused, else the first not completed."""
    order = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase"))
    open_ = F.col("status").isin("running", "failed", "paused")
    own = checkpoints.withColumn("_at", order).where(F.col("status") != "completed")
    best = F.min(F.struct(F.when(open_, 0).otherwise(1).alias("k"), "_at", "phase")).alias("x")
    return own.groupBy("job_id").agg(best).select("job_id", F.col("x.phase").alias("phase"))


def without_follow_up(events: DataFrame, key: str, ts: str, kind: str, first: str, then: str, seconds: int) -> DataFrame:
    """Events of kind ``first`` after which no ``then`` of the same key comes within some seconds.

    The next ``then`` is found by a window, so the events of a key are sorted
    once and no pairs are made.
    """
    ahead = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(0, seconds * 1_000_000)
    own = events.where(F.col(kind).isin(first, then))
    own = own.withColumn("_follow", F.count(F.when(F.col(kind) == then, 1)).over(ahead))
    return own.where((F.col(kind) == first) & (F.col("_follow") == 0)).drop("_follow")
