"""Telemetry queries over the table of events; a user stands for a job."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as S
from siltstone.operators import telemetry as T
from siltstone.registry import query
from siltstone.sources.tables import events, table


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def event_trailing_30s(spark, folder):
    return T.trailing_count(events(spark, folder), "user_id", "ts", 30).select("event_id", "n")


@query("""WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour,
 epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT event_id, in_hour, in_hour > 4 OR coalesce(gap < 900000000, false) AS over FROM c""")
def event_hourly_cap(spark, folder):
    return T.over_cap(events(spark, folder), "user_id", "ts", 4).select("event_id", "in_hour", "over")


@query("""WITH m AS (SELECT user_id, event_type, sum(CASE WHEN event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) SELECT user_id, run, event_type, count(*) AS length FROM m GROUP BY ALL""")
def event_runs(spark, folder):
    return T.runs(events(spark, folder), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase', 'search')) WHERE n <= 5000")
def event_last_5000(spark, folder):
    # the limit is the feature: the log keeps its newest 5,000 entries
    return T.last_n(events(spark, folder), [F.desc("ts"), F.desc("event_id")], 5000, kinds=("event_type", ["view", "click", "purchase", "search"])).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def event_history(spark, folder):
    return T.last_n(events(spark, folder), [F.desc("ts"), F.desc("event_id")], 10, by="user_id").select("event_id", "user_id")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def event_running_max(spark, folder):
    return T.running_max(events(spark, folder), "user_id", ["ts", "event_id"], "value").select("event_id", "peak")


KINDS = {"view": "PageDiscovered", "click": "PageVisited", "error": "PageFailed"}


def job_events(spark, folder):
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return events(spark, folder).withColumn("type", F.element_at(kind, F.col("event_type")))


JOBS = """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS discovered, count(*) FILTER (event_type = 'click') AS visited, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)
"""


@query(JOBS + "SELECT user_id, discovered, visited, failed, greatest(discovered - visited - failed, 0) AS pending, CASE WHEN discovered > 0 THEN least(100, floor(visited * 100.0 / discovered + 0.5))::INT ELSE 0 END AS percent FROM c")
def job_progress(spark, folder):
    own = T.job_counters(job_events(spark, folder), "user_id")
    return own.withColumn("percent", T.progress(F.col("visited"), F.col("discovered")))


@query("SELECT DISTINCT k, 1000 * (2 ** (k - 1))::BIGINT AS doubled_ms, [1000, 2000, 5000, 10000, 20000, 30000, 60000][least(k, 7)]::INT AS step_ms FROM (SELECT event_id % 9 + 1 AS k FROM events)")
def backoff_schedule(spark, folder):
    k = (F.col("event_id") % 9 + 1).alias("k")
    return events(spark, folder).select(k).distinct().withColumn("doubled_ms", S.backoff_ms("k", 1000)).withColumn("step_ms", S.retry_step_ms(F.col("k").cast("int")))


@query("""SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 30 SECOND)""")
def view_without_purchase_30s(spark, folder):
    return T.without_follow_up(events(spark, folder), "user_id", "ts", "event_type", "view", "purchase", 30).select("event_id")


@query("SELECT user_id, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY user_id")
def share_views(spark, folder):
    own = table(spark, folder, "events").where("event_type = 'view'")
    stamp = lambda c: F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return own.groupBy("user_id").agg(stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"), F.count(F.lit(1)).alias("views"))


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick, value FROM events)
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY tick RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS mean FROM s""")
def event_trailing_mean(spark, folder):
    from pyspark.sql import Window

    own = events(spark, folder).withColumn("tick", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return T.trailing_mean(own, "user_id", "tick", "value", 5).select("event_id", F.round("mean", 6).alias("mean"))


@query("""WITH RECURSIVE k AS (SELECT user_id, epoch_us(ts) AS us FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3),
r AS (SELECT user_id, min(us) AS start_us FROM k GROUP BY user_id UNION ALL SELECT user_id, start_us FROM (SELECT r.user_id, min(k.us) AS start_us FROM r JOIN k ON k.user_id = r.user_id AND k.us >= r.start_us + 7200000000 GROUP BY r.user_id, r.start_us))
SELECT user_id, start_us FROM r""")
def event_cooldowns(spark, folder):
    return T.cooldowns(events(spark, folder), "user_id", "ts", 3, 3600, 7200.0)
