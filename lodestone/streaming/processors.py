"""Streams with state and timers: attempts to log in, and parts of uploads.

A row is judged when it comes; what falls due without a row (a run of failures that is over, an upload whose time has run
out) is told by a timer on event time, and takes the key's state with it. Rows of one key in one micro-batch go by their
time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import attrgetter, itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestone.config import DEFAULTS, Settings
from lodestone.operators.uploads import part_outcome

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State with timers needs Spark's store on disk; other streams of the session keep theirs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Timed(StatefulProcessor):
    """One timer a key at most."""

    def init(self, handle) -> None:
        self.handle = handle

    def wake_at(self, micros: int | None, timers) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(max(-(-micros // 1000), timers.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class Throttle(_Timed):
    """Runs of failed logins: see throttle_runs()."""

    def __init__(self, settings: Settings) -> None:
        self.limit, self.window = settings.login_attempt_limit, settings.login_window_seconds * 1_000_000

    def init(self, handle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "failures int, first long, last long")

    def told(self, key: tuple, run: tuple, how: str, at: int) -> tuple:
        failures, first, last = run
        return key[0], how, _time(first), _time(last), failures, _time(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, out = self.run.get() if self.run.exists() else None, []
        frame = pd.concat(list(rows)).sort_values(["ts", "attempt_id"])
        for at, ok in zip(_micros(frame["ts"]), frame["ok"], strict=True):
            if run and at >= run[2] + self.window:
                out.append(self.told(key, run, "expired", run[2] + self.window))
                run = None
            if run and run[0] >= self.limit:
                continue  # refused: neither counts nor prolongs
            if ok:
                if run:
                    out.append(self.told(key, run, "cleared", at))
                run = None
                continue
            run = (run[0] + 1, run[1], at) if run else (1, at, at)
            if run[0] == self.limit:
                out.append(self.told(key, run, "blocked", at))
        if run:
            self.run.update(run)
        else:
            self.run.clear()
        self.wake_at(run[2] + self.window if run else None, timerValues)
        yield pd.DataFrame(out, columns=RUN_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get()
        self.run.clear()
        yield pd.DataFrame([self.told(key, run, "expired", run[2] + self.window)], columns=RUN_NAMES)


RUN_NAMES = ["key", "event", "first_failure", "last_failure", "failures", "at"]
RUN_SCHEMA = "key long, event string, first_failure timestamp, last_failure timestamp, failures int, at timestamp"


def throttle_runs(attempts: DataFrame, settings: Settings = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """What happens to keys by attempts (key, ts, attempt_id, ok): a run of failures is blocked when it reaches the limit,
    cleared by a success before that, or expired a window after its last failure that counted; each with the run's first
    and last failure, how many, and when. Attempts that a block refuses don't count. Nothing waits for later rows: blocks
    and clears come out with the attempt, expiries when the watermark, `late` behind, passes them, or a later attempt
    does."""
    keyed = attempts.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(Throttle(settings), RUN_SCHEMA, "Append", "EventTime")


class PutParts(StatefulProcessor):
    """Parts of the uploads of one bucket: see put_parts_stream(). Rows are plain, times microseconds. Each call for state
    goes to Spark and back, so a bucket's open uploads, with their receipts, are one value, which is read and written once a
    micro-batch that has rows of it; one timer is of the upload whose time is over first."""

    def __init__(self, settings: Settings) -> None:
        self.ttl = settings.upload_session_ttl_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.uploads = handle.getValueState("uploads", "open array<struct<id: long, total: long, part: long, next: long, expires: long, digests: array<string>>>, timer long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from (PART_ROW(*told) for told in self.judged(map(attrgetter(*SENT), rows), timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from (PART_ROW(*told) for told in self.over(timerValues))

    def judged(self, rows: Iterable[tuple], timers) -> list[tuple]:
        """rows: SENT."""
        uploads, timer = self.known()
        before, receipts, changed, out = bool(uploads), {}, False, []
        for now, sent, id_, kind, total_bytes, part_bytes, end, offset, length, sha256, content_bytes, content_sha256 in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
            upload = uploads.get(id_)
            if kind == "open":
                if upload is None:
                    uploads[id_], changed = (total_bytes, part_bytes, 0, end, []), True
                continue
            total, size, at, until, digests = upload or (None, None, 0, None, [])
            if kind in ("cancel", "complete"):
                whole = kind == "cancel" or upload is not None and at == total
                said = "unknown upload" if upload is None else "incomplete" if not whole else {"cancel": "cancelled"}.get(kind, "complete")
                out.append((id_, sent, said, at, None))
                if upload is not None and whole:
                    del uploads[id_]  # with its receipts
                    receipts.pop(id_, None)
                    changed = True
                continue
            seen = receipts.get(id_)
            if seen is None:
                seen = receipts[id_] = confirmed(total, size, digests)
            stated = (sha256 or "").lower()
            said = part_outcome((offset, length, stated, content_bytes, content_sha256), upload and (total, size, at, until, "open"), seen.get(offset), now)
            if said in ("stored", "confirmed again"):
                if said == "stored":
                    seen[offset] = (length, stated)
                    digests.append(stated)
                    at += length
                until = now + self.ttl
                uploads[id_], changed = (total, size, at, until, digests), True
            out.append((id_, sent, said, at, until))
        if changed:
            self.store(uploads, before, timer, timers)
        return out

    def over(self, timers) -> list[tuple]:
        uploads, _ = self.known()
        mark = timers.getCurrentWatermarkInMs()
        over = {id_: u for id_, u in uploads.items() if _millis(u[3]) <= mark}
        self.store({id_: u for id_, u in uploads.items() if id_ not in over}, True, None, timers)  # Spark deletes the timer that led here
        return [(id_, None, "over", u[2], u[3]) for id_, u in over.items()]

    def known(self) -> tuple[dict, int | None]:
        """The open uploads, as total bytes, bytes of a part, next offset, end, and digests of the parts stored; and the timer."""
        rows, timer = self.uploads.get() or ((), None)
        return {u[0]: tuple(u[1:]) for u in rows}, timer

    def store(self, uploads: dict, before: bool, timer: int | None, timers) -> None:
        """A timer that is due in this micro-batch stays: rows of other uploads don't put off what it tells."""
        wake, mark = min((_millis(u[3]) for u in uploads.values()), default=None), timers.getCurrentWatermarkInMs()
        if wake is not None:
            wake = timer if timer is not None and max(wake, timer) <= mark else max(wake, mark + 1)
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is not None and timer != wake:
            self.handle.registerTimer(wake)
        if uploads:
            self.uploads.update(([(id_, *u) for id_, u in uploads.items()], wake))
        elif before:
            self.uploads.clear()


def confirmed(total: int, size: int, digests: list[str]) -> dict:
    """Receipts by offset. Parts are stored in order, each of all the bytes that a part has but the last."""
    return {i * size: (min(size, total - i * size), digest) for i, digest in enumerate(digests)}


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class PutPartsInFrames(PutParts):
    """The same on frames, whose rows come as JSON: a column costs more to carry over than to write and read there, and
    numbers beside nulls would lose digits. In what goes back NO_NUMBER stands for null."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plain = (row for frame in rows for row in json.loads(f"[{','.join(frame['row'])}]", object_hook=itemgetter(*SENT)))
        yield from self.frames(self.judged(plain, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.frames(self.over(timerValues))

    def frames(self, told: list[tuple]) -> Iterator[pd.DataFrame]:
        if told:
            yield pd.DataFrame({name: [NO_NUMBER if v is None else v for v in values] for name, values in zip(PART_NAMES, zip(*told, strict=True), strict=True)})


NO_NUMBER = -(1 << 63)
PART_NAMES = ["upload_id", "sent", "outcome", "next_offset", "until"]
PART_ROW = Row(*PART_NAMES)
PART_SCHEMA = "upload_id long, sent long, outcome string, next_offset long, until long"
SENT = ("now", "sent", "upload_id", "kind", "total_bytes", "part_bytes", "until", "offset_bytes", "length_bytes", "sha256", "content_bytes", "content_sha256")


def put_parts_stream(parts: DataFrame, settings: Settings = DEFAULTS, late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """put_parts() as parts come: upload_id, sent, outcome, next_offset, expires_at.

    parts: upload_id, ts, sent (their order), kind, and by kind: open (total_bytes, part_bytes, expires_at), part
    (offset_bytes, length_bytes, sha256 as stated, content_bytes, content_sha256 of what came), complete, or cancel. Outcomes
    are those of put_parts(), and besides: complete (or incomplete, while bytes are missing); cancelled; and over, by a timer,
    when the watermark passes the time of an upload that no part has renewed. After complete, cancelled and over nothing is
    kept of an upload, and its parts are of an unknown one; until then, its receipts.

    Uploads are dealt to buckets by a hash of their ids, and a bucket's rows are judged in one call: a worker has the rows
    that a micro-batch has of one bucket, and its open uploads. The number of buckets stays for the life of a checkpoint.
    """
    plain = parts.withWatermark("ts", late).withColumns({"now": F.unix_micros("ts"), "until": F.unix_micros("expires_at")})
    row = F.to_json(F.struct(*SENT), {"ignoreNullFields": "false"})
    dealt = plain.select("ts", F.pmod(F.xxhash64("upload_id"), F.lit(buckets)).alias("bucket"), row.alias("row"))
    told = dealt.groupBy("bucket").transformWithStateInPandas(PutPartsInFrames(settings), PART_SCHEMA, "Append", "EventTime")
    whole = {c: F.nullif(F.col(c), F.lit(NO_NUMBER)) for c in ("upload_id", "sent", "until")}
    return told.select(whole["upload_id"].alias("upload_id"), whole["sent"].alias("sent"), "outcome", "next_offset", F.timestamp_micros(whole["until"]).alias("expires_at"))
