"""Queries that run a stream over the events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import query
from lodestone.plans.relational_queries import THROTTLE, throttle_key
from lodestone.streaming import events, processors


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_stream(spark, f"{sf_dir}/events.parquet*")


@query("""WITH f AS (SELECT user_id // 10 AS key, ts, lag(ts) OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS before, event_id FROM events WHERE event_type = 'error'),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 3600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM f)
SELECT key, min(ts) AS first_failure, max(ts) + INTERVAL 3600 SECOND AS ends, count(*) AS failures, count(*) >= 5 AS blocked FROM g GROUP BY key, run HAVING max(ts) + INTERVAL 3600 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM f)""")
def stream_login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed runs of failures. Those that the watermark hasn't passed stay open."""
    failed = stream(spark, sf_dir).filter("event_type = 'error'").select(throttle_key(), "ts")
    found = events.run_available(events.throttle_windows(failed, THROTTLE), "throttle-windows")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_failure", "ends")})


#: Attempts of each key one after the other: c failures before it (none, if the window is over), n after it.
DECIDED = """WITH RECURSIVE tried AS (SELECT user_id // 10 AS key, event_id, ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
decided AS (
  SELECT key, event_id, ts, i, ok, 0 AS c, true AS allowed, CASE WHEN ok THEN 0 ELSE 1 END AS n, ts AS first, ts AS last, NULL::INTEGER AS over, NULL::TIMESTAMP AS over_first, NULL::TIMESTAMP AS over_last FROM tried WHERE i = 1
  UNION ALL
  SELECT key, event_id, ts, i, ok, c, c < 5, CASE WHEN c >= 5 THEN c WHEN ok THEN 0 ELSE c + 1 END, CASE WHEN c = 0 THEN ts ELSE first END, CASE WHEN c < 5 THEN ts ELSE last END,
    CASE WHEN c = 0 AND n > 0 THEN n END, CASE WHEN c = 0 AND n > 0 THEN first END, CASE WHEN c = 0 AND n > 0 THEN last END
  FROM (SELECT t.key, t.event_id, t.ts, t.i, t.ok, d.n, d.first, d.last, CASE WHEN d.n > 0 AND t.ts >= d.last + INTERVAL 3600 SECOND THEN 0 ELSE d.n END AS c FROM decided d JOIN tried t ON t.key = d.key AND t.i = d.i + 1))"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failed logins and purchases as good ones."""
    tried = stream(spark, sf_dir).filter("event_type IN ('error', 'purchase')")
    return tried.select(throttle_key(), "ts", F.col("event_id").alias("attempt_id"), (F.col("event_type") == "purchase").alias("ok"))


@query(f"""{DECIDED} SELECT key, 'expired' AS event, over_first AS first_failure, over_last AS last_failure, over AS failures, over_last + INTERVAL 3600 SECOND AS at FROM decided WHERE over IS NOT NULL
UNION ALL SELECT key, 'cleared', d.first, (SELECT max(e.ts) FROM decided e WHERE e.key = d.key AND e.i < d.i AND NOT e.ok AND e.allowed), d.c, d.ts FROM decided d WHERE ok AND allowed AND c > 0
UNION ALL SELECT key, 'blocked', first, last, n, ts FROM decided WHERE NOT ok AND allowed AND n = 5
UNION ALL SELECT key, 'expired', first, last, n, last + INTERVAL 3600 SECOND FROM decided WHERE n > 0 AND (key, i) IN (SELECT (key, max(i)) FROM tried GROUP BY key) AND last + INTERVAL 3600 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM tried)""")
def stream_throttle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, clears and expiries of all runs of failures, as they fall due."""
    with processors.state_on_disk(spark):
        found = events.run_available(processors.throttle_runs(attempts(spark, sf_dir), THROTTLE), "throttle-runs")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_failure", "last_failure", "at")})


@query(f"{DECIDED} SELECT key, event_id AS attempt_id, allowed, n AS failures FROM decided")
def stream_login_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each attempt is let through."""
    return events.run_available(events.throttle_decisions(attempts(spark, sf_dir), THROTTLE), "throttle-decisions")


@query("SELECT DISTINCT user_id AS upload_id, floor(value)::BIGINT AS offset_bytes FROM events")
def stream_upload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upload parts that are sent again and again."""
    parts = stream(spark, sf_dir).select(F.col("user_id").alias("upload_id"), F.floor("value").alias("offset_bytes"), "ts")
    return events.run_available(events.deduplicated_parts(parts), "upload-parts").select("upload_id", "offset_bytes")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that are over."""
    found = events.run_available(events.hourly(stream(spark, sf_dir)), "hours")
    return found.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
