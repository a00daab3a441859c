"""Streams with timers, batch by batch, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.plans.edit_queries import PART_TYPES
from lodestone.session import new_path
from lodestone.streaming import processors

START = datetime(2024, 1, 1)


def run_in_batches(spark, make, frames):
    """What a stream gives for frames that come one after the other, each in a micro-batch of its own; and the rows of state
    that are left."""
    path, out = new_path(spark, "batches"), new_path(spark, "out")
    rows, left = [], None
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        with processors.state_on_disk(spark):
            stream = make(spark.readStream.schema(frame.schema).parquet(path))
            query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress["stateOperators"] else left
        rows.append(set(map(tuple, spark.read.schema(stream.schema).parquet(out).collect())))
    return rows, left


def runs_model(rows, limit, window):
    """Runs by key, of attempts in order of time; the last one stays open."""
    out, runs = set(), {}
    for at, key, _, ok in sorted(rows):
        run = runs.get(key)
        if run and at >= run[2] + window:
            out.add((key, "expired", run[1], run[2], run[0], run[2] + window))
            run = None
        if not (run and run[0] >= limit):
            if ok:
                if run:
                    out.add((key, "cleared", run[1], run[2], run[0], at))
                run = None
            else:
                run = (run[0] + 1, run[1], at) if run else (1, at, at)
                if run[0] == limit:
                    out.add((key, "blocked", run[1], run[2], run[0], at))
        runs[key] = run
    return out, {k: r for k, r in runs.items() if r}


def test_runs_fall_due_batch_by_batch(spark):
    random.seed(41)
    settings, window = Settings(login_window_seconds=60, login_attempt_limit=3), timedelta(seconds=60)
    rows = sorted((START + timedelta(seconds=random.randint(0, 1500), microseconds=random.randint(0, 999999)), random.randint(0, 2), i, random.random() < 0.2) for i in range(120))
    schema = "ts timestamp, key long, attempt_id long, ok boolean"
    cut = [rows[:50], rows[50:], [(START + timedelta(days=1), 99, 1000, True)]]
    got, left = run_in_batches(spark, lambda s: processors.throttle_runs(s, settings, "1 second"), [spark.createDataFrame(c, schema) for c in cut])
    done, still = runs_model(rows, 3, window)
    first, _ = runs_model(rows[:50], 3, window)
    assert first <= got[0] and {x for x in got[0] if x[1] != "expired"} == {x for x in first if x[1] != "expired"}
    assert got[2] == done | {(k, "expired", r[1], r[2], r[0], r[2] + window) for k, r in still.items()}
    assert left == 0


def part(upload, sent, offset=None, length=None, at=0, kind="part", sha="a", content=None, **more):
    digest = None if offset is None else sha * 64
    row = {"upload_id": upload, "ts": START + timedelta(seconds=at), "sent": sent, "kind": kind, "offset_bytes": offset, "length_bytes": length, "sha256": digest, "content_bytes": length, "content_sha256": content * 64 if content else digest, **more}
    return tuple(row.get(c) for c in PART_TYPES)


def opened(upload, total, expires, at=0):
    return part(upload, 0, kind="open", at=at, total_bytes=total, part_bytes=10, expires_at=START + timedelta(seconds=expires))


@pytest.fixture(scope="module")
def told(spark):
    schema = ", ".join(f"{c} {k}" for c, k in PART_TYPES.items())
    one = [opened(1, 25, 100), opened(2, 10, 50), opened(3, 20, 5000), opened(4, 10, 100), part(1, 2, 10, 10, 2, sha="B", content="b"), part(1, 1, 0, 10, 1), part(1, 3, 0, 10, 3), part(1, 4, 0, 10, 4, sha="c"), part(9, 1, 0, 10, 1)]
    one += [part(3, 1, 0, 9, 1), part(3, 2, 0, 10, 2, content="d"), part(3, 3, 10, 10, 3), part(3, 4, 0, 10, 4, sha="z"), part(3, 5, 0, 10, 5), part(3, 6, kind="complete", at=6)]
    two = [part(1, 5, 20, 5, 60), part(1, 6, kind="complete", at=61), part(1, 7, 0, 10, 62), part(4, 1, 0, 10, 100), part(3, 7, kind="cancel", at=70), part(3, 8, 10, 10, 71)]
    three = [opened(50, 1, 100_000, 90_000)]
    frames = [spark.createDataFrame(x, schema) for x in (one, two, three)]
    return run_in_batches(spark, lambda s: processors.put_parts_stream(s, Settings(upload_session_ttl_seconds=3600), "1 second"), frames)


def test_parts_in_any_order_of_files(told):
    got, _ = told
    said = {(u, n): (o, at) for u, n, o, at, _ in got[2] if n is not None}
    assert said == {
        (1, 1): ("stored", 10), (1, 2): ("stored", 20), (1, 3): ("confirmed again", 20), (1, 4): ("other bytes", 20), (1, 5): ("stored", 25), (1, 6): ("complete", 25), (1, 7): ("unknown upload", 0),
        (9, 1): ("unknown upload", 0), (4, 1): ("expired", 0),
        (3, 1): ("wrong length", 0), (3, 2): ("checksum mismatch", 0), (3, 3): ("wrong offset", 0), (3, 4): ("invalid checksum", 0), (3, 5): ("stored", 10), (3, 6): ("incomplete", 10), (3, 7): ("cancelled", 10), (3, 8): ("unknown upload", 0),
    }
    assert {x[4] for x in got[2] if x[:3] == (1, 5, "stored")} == {START + timedelta(seconds=60 + 3600)}


def test_uploads_whose_time_is_over_come_out_and_leave_no_state(told):
    got, left = told
    over = {(u, at) for u, n, o, at, _ in got[2] if n is None}
    assert over == {(2, 0), (4, 0)} and not any(n is None for _, n, *_ in got[0])
    assert left == 1  # the upload just opened
    assert got[0] < got[1] <= got[2]


def test_other_streams_keep_their_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with processors.state_on_disk(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == processors.ROCKS
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert spark.range(1).select(F.lit(1)).count() == 1


class Counted:
    """A handle, its states and its timers, that counts what is asked of them."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        if name in ("getValueState", "getListState", "getMapState"):
            return lambda *_: self
        return lambda *_: self.calls.append(name)

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_is_asked_once_for_an_upload_that_begins_and_ends_in_a_batch():
    made, handle = processors.PutParts(Settings()), Counted()
    made.init(handle)
    names = [*PART_TYPES, "now", "until"]
    rows = [part(1, 0, kind="open", total_bytes=1000, part_bytes=10)] + [part(1, n + 1, 10 * n, 10) for n in range(100)] + [part(1, 101, kind="complete")]
    rows = [Row(*names)(*r, 5, 10) for r in rows]
    said = [r.outcome for r in made.handleInputRows((1,), iter(rows), handle)]
    assert said == ["stored"] * 100 + ["complete"] and handle.calls == ["get"]


def rows_of(*parts):
    return [Row(*PART_TYPES, "now", "until")(*p, p[1].timestamp() * 1e6, p[6] and p[6].timestamp() * 1e6) for p in parts]


def test_state_is_asked_once_for_all_uploads_of_a_bucket():
    made, handle = processors.PutParts(Settings()), Counted()
    made.init(handle)
    rows = [p for n in range(50) for p in (opened(n, 20, 100), part(n, 1, 0, 10), part(n, 2, 10, 9))]
    told = [tuple(r)[:4] for r in made.handleInputRows((7,), iter(rows_of(*rows)), handle)]
    assert sorted(told) == [x for n in range(50) for x in ((n, 1, "stored", 10), (n, 2, "wrong length", 10))]
    assert handle.calls == ["get", "registerTimer", "update"]


class Held(Counted):
    """The same with one value that it keeps, at a watermark."""

    value, mark = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_rows_of_an_upload_dont_put_off_the_end_of_another():
    made, handle = processors.PutParts(Settings()), Held()
    made.init(handle)
    assert not list(made.handleInputRows((7,), iter(rows_of(opened(1, 20, 100), opened(2, 20, 5000))), handle))
    handle.mark = int((START + timedelta(seconds=200)).timestamp() * 1000)
    assert [r.outcome for r in made.handleInputRows((7,), iter(rows_of(part(2, 1, 0, 10, 300))), handle)] == ["stored"]
    assert handle.calls == ["registerTimer"]
    assert [tuple(r)[:3] for r in made.handleExpiredTimer((7,), handle, None)] == [(1, None, "over")]
    assert [u[0] for u in handle.value[0]] == [2] and handle.calls == ["registerTimer", "registerTimer"]


def test_uploads_of_one_bucket_are_told_apart(spark):
    one, two, schema = (1 << 60) + 1, (1 << 60) + 2, ", ".join(f"{c} {k}" for c, k in PART_TYPES.items())
    first = [opened(one, 20, 100), opened(two, 20, 5000), part(two, 1, 0, 10, 1, sha="B", content="b"), part(one, None, 5, 10, 1), part(None, 1, 0, 10, 1)]
    second = [part(two, 2, 0, 10, 200, sha="b"), part(two, 3, 10, 10, 200), part(two, 4, kind="complete", at=201)]
    frames = [spark.createDataFrame(x, schema) for x in (first, second)]
    got, left = run_in_batches(spark, lambda s: processors.put_parts_stream(s, Settings(upload_session_ttl_seconds=3600), "1 second", buckets=1), frames)
    told = [{x[:4] for x in rows} for rows in got]
    assert told[0] == {(two, 1, "stored", 10), (one, None, "wrong offset", 0), (None, 1, "unknown upload", 0)}
    assert told[1] - told[0] == {(two, 2, "confirmed again", 10), (two, 3, "stored", 20), (two, 4, "complete", 20), (one, None, "over", 0)}
    assert left == 0
