"""Streaming twins of the time-driven operators, over a file source of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.config import DEFAULTS, Settings
from lodestone.session import new_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of the files that match a path, as they come; times are instants in the session's zone, which is UTC."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into Parquet in the shared folder, and returns what it wrote."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def throttle_windows(failures: DataFrame, settings: Settings = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """Runs of failed logins (key, ts) as they close: a run ends with the window after its last failure, and comes out
    when the watermark, `late` behind the latest event, has passed that."""
    runs = failures.withWatermark("ts", late).groupBy("key", F.session_window("ts", f"{settings.login_window_seconds} seconds").alias("run"))
    found = runs.agg(F.count("*").alias("failures"))
    return found.select("key", F.col("run.start").alias("first_failure"), F.col("run.end").alias("ends"), "failures", (F.col("failures") >= settings.login_attempt_limit).alias("blocked"))


def throttle_decisions(attempts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each login attempt (key, ts, attempt_id, ok) with allowed and failures so far.

    A failure counts and starts the window anew; a success clears the count; at the limit, attempts are refused until a
    window has passed since the last failure that counted, and refusals don't prolong it. A key's state goes when the
    watermark has passed its window.
    """
    limit, window = settings.login_attempt_limit, settings.login_window_seconds

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "attempt_id"])
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        out = []
        for at, attempt, ok in zip(seconds, rows["attempt_id"], rows["ok"], strict=True):
            if count and at >= last + window:
                count = 0
            allowed = count < limit
            if allowed:
                count, last = (0, at) if ok else (count + 1, at)
            out.append((key[0], attempt, allowed, count))
        state.update((int(count), float(last)))
        state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "attempt_id", "allowed", "failures"])

    keyed = attempts.withWatermark("ts", "10 minutes").groupBy("key")
    return keyed.applyInPandasWithState(decide, "key long, attempt_id long, allowed boolean, failures int", "failures int, last double", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated_parts(parts: DataFrame, late: str = "24 hours") -> DataFrame:
    """Upload parts (upload_id, offset_bytes, ts), each once however often it is sent, for as long as an upload lives."""
    return parts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["upload_id", "offset_bytes"])


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each hour by type, once the hour is over and the watermark past it."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("hour"), "event_type")
    return by.agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), "event_type", "n")
