"""State machines of a crawl: one definition, folded over a table here and run as a stream with timers in streaming/state.py.

A machine takes the rows of a key in order of time and may wait for a time of
its own: what is due up to a row's time happens before that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Milliseconds to wait before each further try; what makes a run rest, for how long, and what restores a worker.
BACKOFF = (1000, 2000, 4000, 8000, 16000, 30000, 60000)
LIMITS, LIMITS_WITHIN, REST, REST_ADAPTIVE, RESTORE = 10, 30_000, 45_000, 1.5, 3
#: Of a run that has paused: how many times the required samples without news end it.
EXHAUSTED = 3


@dataclass(frozen=True)
class Machine:
    """``step`` (state, row) and ``fire`` (state, now) give a new state (lists and numbers only) and rows of ``out``; ``due`` is when it wants to be woken."""

    start: list
    columns: str
    out: str
    step: Callable[[list, dict], tuple[list, list[tuple]]]
    due: Callable[[list], int | None] = lambda state: None
    fire: Callable[[list, int], tuple[list, list[tuple]]] = lambda state, now: (state, [])

    def waits(self, state: list, before: int | None) -> tuple[list, list[tuple]]:
        """What falls due up to and with a time; everything if that is null."""
        told: list[tuple] = []
        while (at := self.due(state)) is not None and (before is None or at <= before):
            state, more = self.fire(state, at)
            told += more
        return state, told

    def taken(self, state: list, row: dict) -> tuple[list, list[tuple]]:
        state, early = self.waits(state, row["at"])
        state, told = self.step(state, row)
        return state, early + told


def fold(rows: DataFrame, key: str, machine: Machine) -> DataFrame:
    """What ``machine`` tells of each key's rows (key, at, place), taken by time and place.

    Keys are spread by hash and sorted within their partitions, where Spark
    spills; a task holds one batch of rows and the state of the key at hand.
    """
    kinds = dict(rows.dtypes)
    names = [x.split()[0] for x in machine.columns.split(", ")]
    out = to_arrow_schema(StructType.fromDDL(machine.out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        told: list[tuple] = []

        def ready() -> pa.RecordBatch:
            keys = pa.array([k for k, _ in told], key_type)
            return pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for _, r in told], f.type) for i, f in enumerate(out))], [key, *out.names])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for row in batch.to_pylist():
                if state is None or row[key] != here:
                    if state is not None:
                        told += [(here, x) for x in machine.waits(state, None)[1]]
                    here, state = row[key], machine.start
                state, more = machine.taken(state, row)
                told += [(here, x) for x in more]
                if len(told) >= 8192:
                    yield ready()
                    told = []
        if state is not None:
            told += [(here, x) for x in machine.waits(state, None)[1]]
            yield ready()

    own = rows.select(key, *names).repartition(key).sortWithinPartitions(key, "at", "place")
    return own.mapInArrow(run, f"`{key}` {kinds[key]}, {machine.out}")


def counters() -> Machine:
    """After each event (type) of a job: pages discovered, visited, failed, and pending, which never falls below 0."""

    def step(state: list, row: dict) -> tuple[list, list[tuple]]:
        discovered, visited, failed, pending = state
        kind = row["type"]
        if kind == "PageDiscovered":
            discovered, pending = discovered + 1, pending + 1
        elif kind == "PageVisited":
            visited, pending = visited + 1, max(0, pending - 1)
        elif kind == "PageFailed":
            failed, pending = failed + 1, max(0, pending - 1)
        return [discovered, visited, failed, pending], [(row["at"], row["place"], discovered, visited, failed, pending)]

    return Machine([0, 0, 0, 0], "at long, place long, type string", "at long, place long, discovered long, visited long, failed long, pending long", step)


def limiter(base: int, adaptive: bool = True, backoff: tuple[int, ...] = BACKOFF, limits: int = LIMITS, within: int = LIMITS_WITHIN, rest: int = REST) -> Machine:
    """After each outcome (limited, or not) of a run: workers, wait before the next try, and until when it rests.

    A limit halves the workers (or takes one); from the third success on each
    gives one back, outside rests.  ``limits`` limits within a time start a rest,
    unless one is under way.  The wait grows with limits that say none
    (retry_after_s), and shrinks again from the sixth success on.
    """
    longer = round(rest * REST_ADAPTIVE) if adaptive else rest

    def step(state: list, row: dict) -> tuple[list, list[tuple]]:
        workers, successes, wait, until, recent = state
        now = row["at"]
        if row["limited"]:
            successes = 0
            recent = [t for t in [*recent, now] if now - t < within][-limits:]  # more than that tell nothing
            workers = max(1, workers // 2 if adaptive else workers - 1)
            if not (row["retry_after_s"] or 0) > 0:
                wait = min(wait + 1, len(backoff) - 1)
            if len(recent) >= limits and now >= until:
                until = now + longer
        else:
            successes += 1
            if adaptive and successes >= RESTORE and workers < base and now >= until:
                workers += 1
            if wait > 0 and successes >= 2 * RESTORE:
                wait -= 1
        said = row["retry_after_s"] or 0
        delay = said * 1000 if row["limited"] and said > 0 else backoff[wait] if wait >= 0 else 1000
        return [workers, successes, wait, until, recent], [(now, row["place"], workers, delay, until)]

    return Machine([base, 0, -1, 0, []], "at long, place long, limited boolean, retry_after_s long", "at long, place long, workers int, delay_ms long, rest_until long", step)


def verdict(required: int = 3, tolerance: float = 0.05) -> Machine:
    """After each sample of a run: continue, pause_discovery, complete or exhausted, and why.

    The first sample is only a base.  A run whose queue is empty and whose
    workers rest is complete.  ``required`` samples on end without news
    while the queue waits pause discovery, EXHAUSTED times as many more end the run; so
    do as many samples without any change pause it.
    """

    def step(state: list, row: dict) -> tuple[list, list[tuple]]:
        before, unchanged, stagnant, paused, since = state
        now = [row[c] for c in ("queue_size", "knowledge_size", "discovered", "processed", "memory_rss")]
        tell = lambda word, why, *rest: ([now, *rest], [(row["at"], row["place"], word, why)])
        if before is None:
            return tell("continue", "baseline", 0, 0, False, 0)
        queue, knowledge, discovered, processed = (a == b for a, b in zip(now[:4], before[:4], strict=True))
        waiting = now[0] > 0
        healthy = not (waiting and processed and row["active_workers"] == 0)
        memory = before[4] == 0 or abs(now[4] - before[4]) <= before[4] * tolerance
        unchanged = unchanged + 1 if queue and knowledge and discovered and processed and healthy and memory else 0
        stagnant = stagnant + 1 if knowledge and discovered and processed and waiting else 0
        if now[0] == 0 and row["active_workers"] == 0:
            return tell("complete", "queue_drained", unchanged, stagnant, False, since)
        if stagnant >= required:
            if not paused:
                return tell("pause_discovery", "knowledge_stagnation", unchanged, stagnant, True, 0)
            if since + 1 >= required * EXHAUSTED:
                return tell("exhausted", "exhausted", unchanged, stagnant, True, since + 1)
            return tell("pause_discovery", "knowledge_stagnation", unchanged, stagnant, True, since + 1)
        if unchanged >= required and waiting:
            return tell("pause_discovery", "all_criteria_stable", unchanged, stagnant, True, since if paused else 0)
        return tell("continue", "active", unchanged, stagnant, False, 0 if paused else since)

    columns = "at long, place long, queue_size long, knowledge_size long, discovered long, processed long, memory_rss long, active_workers long"
    return Machine([None, 0, 0, False, 0], columns, "at long, place long, verdict string, reason string", step)


def retries(most: int = 3, backoff: tuple[int, ...] = BACKOFF) -> Machine:
    """Of an address that fails (failed): when each further try is due, and when its tries are used up.

    A success forgets the count, and the earliest planned of its waiting tries.
    Told are tries as they fall due (state ``due``, at that time) and failures past the last try (``failed``).
    """

    def step(state: list, row: dict) -> tuple[list, list[tuple]]:
        tries, waiting = state
        if not row["failed"]:
            return [0, waiting[1:]], []
        if tries + 1 > most:
            return [0, waiting], [(row["at"], row["place"], "failed", tries + 1)]
        return [tries + 1, [*waiting, [row["at"] + backoff[min(tries, len(backoff) - 1)], row["place"], tries + 1]]], []

    def due(state: list) -> int | None:
        return min((at for at, _, _ in state[1]), default=None)

    def fire(state: list, now: int) -> tuple[list, list[tuple]]:
        ready = sorted((x for x in state[1] if x[0] <= now), key=lambda x: (x[0], x[1]))
        return [state[0], [x for x in state[1] if x[0] > now]], [(at, place, "due", n) for at, place, n in ready]

    return Machine([0, []], "at long, place long, failed boolean", "at long, place long, state string, attempt int", step, due, fire)
