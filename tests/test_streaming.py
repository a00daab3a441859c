"""Streams against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.streaming import events

SETTINGS = Settings(login_window_seconds=60, login_attempt_limit=3)


def model(rows):
    out, state = {}, {}
    for at, key, attempt, ok in sorted(rows):
        count, last = state.get(key, (0, None))
        if count and at >= last + timedelta(seconds=60):
            count = 0
        allowed = count < 3
        if allowed:
            count, last = (0, at) if ok else (count + 1, at)
        state[key] = (count, last)
        out[attempt] = (allowed, count)
    return out


def test_throttle_decisions(spark, tmp_path):
    random.seed(5)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=random.randint(0, 1500)), random.randint(0, 3), i, random.random() < 0.2) for i in range(300)]
    frame = spark.createDataFrame([(a, k, i, o) for a, k, i, o in rows], "ts timestamp, key long, attempt_id long, ok boolean")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = events.run_available(events.throttle_decisions(stream, SETTINGS), "decisions").collect()
    assert {r.attempt_id: (r.allowed, r.failures) for r in got} == model(rows)


def test_parts_are_taken_once(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0), (1, 0), (1, 5), (2, 0)], "upload_id long, offset_bytes long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = events.run_available(events.deduplicated_parts(stream), "parts").select("upload_id", "offset_bytes").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 5), (2, 0)]


def test_throttle_keys_grow_with_the_users(spark):
    from lodestone.plans import QUERIES

    sf = "/root/testdata/sf0.01"
    tried = spark.read.parquet(f"{sf}/events.parquet").filter("event_type IN ('error', 'purchase')")
    users = tried.select((F.floor(F.col("user_id") / 10)).alias("key")).distinct().count()
    found = QUERIES["stream_login_decisions"](spark, sf)
    assert found.select("key").distinct().count() == users > 10 and found.count() == tried.count()
    assert QUERIES["stream_login_throttle"](spark, sf).select("key").distinct().count() > 10
