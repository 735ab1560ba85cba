"""Queries of the crawl's state machines over events, as folds and as streams; the SQL of both takes the events of a user one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import machines as M
from siltstone.registry import query
from siltstone.streaming import state
from siltstone.streaming.plans import event_stream
from siltstone.sources.tables import table

HOUR = 3_600_000
#: What the events stand for, in Spark's and DuckDB's SQL.
AS_PAGES = "CASE event_type WHEN 'view' THEN 'PageDiscovered' WHEN 'click' THEN 'PageVisited' WHEN 'error' THEN 'PageFailed' ELSE 'PageParsed' END AS type"
AS_OUTCOMES = "event_type IN ('error', 'view') AS limited, CASE WHEN event_id % 5 = 0 THEN 3600 * (event_id % 2) END AS retry_after_s"
AS_SAMPLES = """CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 6 ELSE 5 END AS queue_size, CASE WHEN event_id % 13 = 0 THEN 8 ELSE 7 END AS knowledge_size, 9 AS discovered,
 CASE WHEN event_id % 17 = 0 THEN 5 ELSE 4 END AS processed, CASE WHEN event_id % 19 = 0 THEN 0 ELSE 100 + event_id % 3 END AS memory_rss, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS active_workers"""
AS_TRIES = "event_type <> 'purchase' AS failed"

LIMITER = M.limiter(8, True, tuple(HOUR * s for s in (1, 2, 4, 8, 16, 30, 60)), 4, 24 * HOUR, 48 * HOUR)
VERDICT = M.verdict(3)
RETRIES = M.retries(2, (6 * HOUR, 30 * HOUR, 60 * HOUR))


def rows(events: DataFrame, stands_for: str, at: Column) -> DataFrame:
    return events.select("user_id", at.alias("at"), F.col("event_id").alias("place"), F.expr(f"struct({stands_for})").alias("x")).select("user_id", "at", "place", "x.*")


def folded(spark, folder: str, stands_for: str, machine: M.Machine) -> DataFrame:
    return M.fold(rows(table(spark, folder, "events"), stands_for, F.unix_millis(F.col("ts").cast("timestamp"))), "user_id", machine)


def streamed(spark, folder: str, stands_for: str, machine: M.Machine) -> DataFrame:
    # the machine has a watermark of its own, on whole milliseconds
    source = lambda s: rows(event_stream(s, folder, None), stands_for, F.unix_millis("ts"))
    return state.settled(spark, source, "user_id", machine)


def steps(stands_for: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", place) AS n FROM (SELECT user_id, epoch_us(ts) // 1000 AS "at", event_id AS place, {stands_for} FROM events)),
"""


# What is pending after each event is the sum of ups and downs above its lowest point so far.
COUNTERS = (
    steps(AS_PAGES)
    + """s AS (SELECT *, count(*) FILTER (type = 'PageDiscovered') OVER w AS discovered, count(*) FILTER (type = 'PageVisited') OVER w AS visited, count(*) FILTER (type = 'PageFailed') OVER w AS failed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT user_id, "at", place, discovered, visited, failed, discovered - visited - failed - least(0, min(discovered - visited - failed) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)) AS pending FROM s"""
)

LIMITS = (
    steps(AS_OUTCOMES)
    + f"""r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS "at", NULL::BIGINT AS place, 8 AS workers, 0 AS successes, -1 AS wait, 0::BIGINT AS until, []::BIGINT[] AS recent, 0::BIGINT AS said FROM e
 UNION ALL SELECT user_id, n, "at", place,
  CASE WHEN limited THEN greatest(1, workers // 2) WHEN successes + 1 >= 3 AND workers < 8 AND "at" >= until THEN workers + 1 ELSE workers END, CASE WHEN limited THEN 0 ELSE successes + 1 END,
  CASE WHEN limited AND said = 0 THEN least(wait + 1, 6) WHEN NOT limited AND wait > 0 AND successes + 1 >= 6 THEN wait - 1 ELSE wait END,
  CASE WHEN limited AND len(now) >= 4 AND "at" >= until THEN "at" + {72 * HOUR} ELSE until END, CASE WHEN limited THEN now ELSE recent END, CASE WHEN limited THEN said ELSE 0 END
  FROM (SELECT e.user_id, e.n, e."at", e.place, workers, successes, wait, until, recent, limited, coalesce(retry_after_s, 0) AS said, list_filter(list_append(recent, e."at"), lambda t: e."at" - t < {24 * HOUR}) AS now FROM r JOIN e ON r.user_id = e.user_id AND e.n = r.n + 1))
SELECT user_id, "at", place, workers, CASE WHEN said > 0 THEN said * 1000 WHEN wait < 0 THEN 1000 ELSE {HOUR} * ([1, 2, 4, 8, 16, 30, 60])[wait + 1] END::BIGINT AS delay_ms, until AS rest_until FROM r WHERE n > 0"""
)

SAMPLES = (
    steps(AS_SAMPLES)
    + """d AS MATERIALIZED (SELECT *, queue_size = lag(queue_size) OVER w AS q, knowledge_size = lag(knowledge_size) OVER w AND processed = lag(processed) OVER w AS k, NOT (queue_size > 0 AND active_workers = 0 AND processed = lag(processed) OVER w) AS healthy,
  lag(memory_rss) OVER w = 0 OR abs(memory_rss - lag(memory_rss) OVER w) <= 0.05 * lag(memory_rss) OVER w AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)),
r AS (SELECT user_id, n, "at", place, 0 AS unchanged, 0 AS stagnant, false AS paused, 0 AS since, 'continue' AS verdict, 'baseline' AS reason FROM d WHERE n = 1
 UNION ALL SELECT user_id, n, "at", place, u, g, verdict NOT IN ('complete', 'continue'), CASE WHEN verdict = 'complete' THEN since WHEN NOT paused THEN CASE WHEN verdict = 'continue' THEN since ELSE 0 END WHEN g >= 3 THEN since + 1 WHEN verdict = 'continue' THEN 0 ELSE since END, verdict,
  CASE WHEN verdict = 'complete' THEN 'queue_drained' WHEN verdict = 'continue' THEN 'active' WHEN verdict = 'exhausted' THEN 'exhausted' WHEN g >= 3 THEN 'knowledge_stagnation' ELSE 'all_criteria_stable' END
  FROM (SELECT *, CASE WHEN queue_size = 0 AND active_workers = 0 THEN 'complete' WHEN g >= 3 AND paused AND since + 1 >= 9 THEN 'exhausted' WHEN g >= 3 OR (u >= 3 AND queue_size > 0) THEN 'pause_discovery' ELSE 'continue' END AS verdict
   FROM (SELECT d.user_id, d.n, d."at", d.place, queue_size, active_workers, paused, since, CASE WHEN q AND k AND healthy AND m THEN unchanged + 1 ELSE 0 END AS u, CASE WHEN k AND queue_size > 0 THEN stagnant + 1 ELSE 0 END AS g FROM r JOIN d ON r.user_id = d.user_id AND d.n = r.n + 1)))
SELECT user_id, "at", place, verdict, reason FROM r"""
)

TRIES = (
    steps(AS_TRIES)
    + f"""r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0 AS tries, []::STRUCT(due BIGINT, place BIGINT, attempt INTEGER)[] AS waiting, []::STRUCT("at" BIGINT, place BIGINT, state VARCHAR, attempt INTEGER)[] AS told FROM e
 UNION ALL SELECT user_id, n, CASE WHEN failed AND tries < 2 THEN tries + 1 ELSE 0 END,
  CASE WHEN NOT failed THEN still[2:] WHEN tries < 2 THEN list_append(still, struct_pack(due := "at" + {HOUR} * ([6, 30])[tries + 1], place := place, attempt := tries + 1)) ELSE still END,
  list_concat(list_transform(list_filter(waiting, lambda x: x.due <= "at"), lambda x: struct_pack("at" := x.due, place := x.place, state := 'due', attempt := x.attempt)), CASE WHEN failed AND tries >= 2 THEN [struct_pack("at" := "at", place := place, state := 'failed', attempt := 3)] ELSE [] END)
  FROM (SELECT e.*, tries, waiting, list_filter(waiting, lambda x: x.due > e."at") AS still FROM r JOIN e ON r.user_id = e.user_id AND e.n = r.n + 1)),
l AS (SELECT user_id, unnest(waiting) AS x FROM r QUALIFY n = max(n) OVER (PARTITION BY user_id)),
t AS (SELECT user_id, unnest(told) AS x FROM r)
SELECT user_id, x."at" AS "at", x.place AS place, x.state AS state, x.attempt AS attempt FROM t UNION ALL SELECT user_id, x.due, x.place, 'due', x.attempt FROM l"""
)


@query(COUNTERS)
def job_counters_running(spark, folder):
    return folded(spark, folder, AS_PAGES, M.counters())


@query(COUNTERS)
def stream_job_counters(spark, folder):
    return streamed(spark, folder, AS_PAGES, M.counters())


@query(LIMITS)
def worker_limits(spark, folder):
    return folded(spark, folder, AS_OUTCOMES, LIMITER)


@query(LIMITS)
def stream_worker_limits(spark, folder):
    return streamed(spark, folder, AS_OUTCOMES, LIMITER)


@query(SAMPLES)
def run_verdicts(spark, folder):
    return folded(spark, folder, AS_SAMPLES, VERDICT)


@query(SAMPLES)
def stream_run_verdicts(spark, folder):
    return streamed(spark, folder, AS_SAMPLES, VERDICT)


@query(TRIES)
def retry_queue(spark, folder):
    return folded(spark, folder, AS_TRIES, RETRIES)


@query(TRIES)
def stream_retry_queue(spark, folder):
    return streamed(spark, folder, AS_TRIES, RETRIES)
