"""Resumable uploads: sessions, parts and what becomes of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.text import suffix
from lodestone.sources.formats import MEDIA_TYPES


def plan_parts(uploads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(upload_id, offset_bytes, length_bytes) of the parts that uploads (upload_id, total_bytes) go up in."""
    step = settings.upload_part_bytes
    starts = F.sequence(F.lit(0).cast("long"), F.col("total_bytes") - 1, F.lit(step).cast("long"))
    rows = uploads.filter("total_bytes > 0").select("upload_id", "total_bytes", F.explode(starts).alias("offset_bytes"))
    return rows.select("upload_id", "offset_bytes", F.least(F.lit(step).cast("long"), F.col("total_bytes") - F.col("offset_bytes")).alias("length_bytes"))


def audit_offsets(receipts: DataFrame) -> DataFrame:
    """receipts (upload_id, offset_bytes, length_bytes) with expected_offset, the bytes before, and in_order."""
    before = Window.partitionBy("upload_id").orderBy("offset_bytes").rowsBetween(Window.unboundedPreceding, -1)
    rows = receipts.withColumn("expected_offset", F.coalesce(F.sum("length_bytes").over(before), F.lit(0)))
    return rows.withColumn("in_order", F.col("offset_bytes") == F.col("expected_offset"))


def reconcile(sessions: DataFrame, as_of: str) -> DataFrame:
    """The sessions (with expires_at) whose time isn't over: what is judged at a time is judged against these."""
    return sessions.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def admit(requests: DataFrame, documents: DataFrame, sessions: DataFrame, as_of: str, settings: Settings = DEFAULTS) -> DataFrame:
    """create_sessions() at a time: sessions whose time is over take no place, aren't resumed and don't conflict; a session
    that is resumed is renewed like one that is created, and expires_at says until when (null for other outcomes)."""
    judged = create_sessions(requests, documents, reconcile(sessions, as_of), settings)
    renewed = F.lit(as_of).cast("timestamp") + F.make_dt_interval(secs=F.lit(settings.upload_session_ttl_seconds))
    return judged.withColumn("expires_at", F.when(F.col("outcome").isin("resumed", "created"), renewed))


def create_sessions(requests: DataFrame, documents: DataFrame, sessions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """requests (request_id, knowledge_base_id, original_name, sha256, size_bytes) with outcome, in order of precedence:
    format, too large, duplicate document, resumed, other file, capacity, created.

    documents: knowledge_base_id, sha256; sessions: knowledge_base_id, declared_sha256, total_bytes, status, all of them
    taken to be alive, as admit() sees to. Places are given in order of request_id; requests for one file count as one.
    """
    open_ = sessions.filter("status = 'open'")
    same = open_.groupBy("knowledge_base_id", F.col("declared_sha256").alias("sha256")).agg(F.max("total_bytes").alias("_size"))
    there = documents.select("knowledge_base_id", "sha256").distinct().withColumn("_there", F.lit(True))
    taken = open_.agg(F.count("*").alias("_taken"))
    rows = requests.join(there, ["knowledge_base_id", "sha256"], "left").join(same, ["knowledge_base_id", "sha256"], "left")
    early = (
        F.when(~suffix(F.col("original_name")).isin(*MEDIA_TYPES), "format")
        .when(F.col("size_bytes") > settings.max_upload_bytes, "too large")
        .when(F.col("_there").isNotNull(), "duplicate document")
        .when(F.col("_size") == F.col("size_bytes"), "resumed")
        .when(F.col("_size").isNotNull(), "other file")
    )
    rows = rows.withColumn("_early", early)
    new = rows.filter("_early IS NULL").groupBy("knowledge_base_id", "sha256").agg(F.min("request_id").alias("request_id"))
    first = new.orderBy("request_id").limit(settings.max_active_upload_sessions)  # more can't get a place
    place = first.select("request_id", F.row_number().over(Window.orderBy("request_id")).alias("_place"))
    rows = rows.join(place, "request_id", "left").join(F.broadcast(taken))  # one row
    free = F.col("_taken") + F.col("_place") <= settings.max_active_upload_sessions
    late = F.when(F.coalesce(free, F.lit(False)), "created").otherwise("capacity")
    return rows.select("request_id", "knowledge_base_id", "sha256", F.coalesce("_early", late).alias("outcome"))


def complete_sessions(sessions: DataFrame, files: DataFrame, documents: DataFrame, as_of: str, settings: Settings = DEFAULTS) -> DataFrame:
    """sessions with outcome, in order of precedence: completed before, not open, expired, incomplete, no file, other
    content, capacity, duplicate document, completed.

    files: upload_id, size_bytes, sha256 of what has arrived; documents: knowledge_base_id, sha256.
    """
    found = files.select("upload_id", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha256"))
    there = documents.select("knowledge_base_id", F.col("sha256").alias("declared_sha256")).distinct().withColumn("_there", F.lit(True))
    n = documents.agg(F.count("*").alias("_n"))
    rows = sessions.join(found, "upload_id", "left").join(there, ["knowledge_base_id", "declared_sha256"], "left").join(F.broadcast(n))  # one row
    outcome = (
        F.when(F.col("status") == "completed", "completed before")
        .when(F.col("status") != "open", "not open")
        .when(F.col("expires_at") <= F.lit(as_of).cast("timestamp"), "expired")
        .when(F.col("received_bytes") != F.col("total_bytes"), "incomplete")
        .when(F.col("_size").isNull(), "no file")
        .when((F.col("_size") != F.col("total_bytes")) | (F.col("_sha256") != F.col("declared_sha256")), "other content")
        .when(F.col("_n") >= settings.max_documents, "capacity")
        .when(F.col("_there").isNotNull(), "duplicate document")
        .otherwise("completed")
    )
    return rows.select("upload_id", "knowledge_base_id", outcome.alias("outcome"))


def part_outcome(part: tuple, upload: tuple | None, seen: tuple | None, now: int) -> str:
    """What one part comes to. part: offset, length, stated digest, bytes and digest of what came; upload: total bytes, bytes
    of a part, next offset, when its time is over, status; seen: length and digest of what was confirmed at the offset."""
    offset, length, stated, came, digest = part
    if not re.fullmatch("[0-9a-f]{64}", stated or ""):
        return "invalid checksum"
    if upload is None:
        return "unknown upload"
    total, size, at, until, status = upload
    if until <= now:
        return "expired"
    if status != "open":
        return "not open"
    if seen is not None:
        return "confirmed again" if seen == (length, stated) else "other bytes"
    if offset != at:
        return "wrong offset"
    expected = min(size, total - offset)
    if length != expected or came != expected:
        return "wrong length"
    return "stored" if digest == stated else "checksum mismatch"


def put_parts(sessions: DataFrame, receipts: DataFrame, parts: DataFrame, as_of: str, settings: Settings = DEFAULTS) -> DataFrame:
    """What each part comes to, as upload_id, sent, outcome, next_offset and expires_at.

    sessions: upload_id, total_bytes, part_bytes, received_bytes, status, expires_at; receipts: upload_id, offset_bytes,
    length_bytes, sha256 of the parts confirmed before; parts: upload_id, sent (their order), offset_bytes, length_bytes,
    sha256 as the sender states them, content_bytes and content_sha256 of what came. Outcomes in order of precedence:
    invalid checksum, unknown upload, expired, not open, confirmed again (the very part was there), other bytes, wrong
    offset, wrong length, checksum mismatch, stored. A part that is stored or confirmed again renews the session.

    Each upload's receipts and parts are sorted into one task and read once, in order; a task has the receipts of one upload
    at a time, at most as many as its bytes make parts.
    """
    kind = parts.schema["upload_id"].dataType.simpleString()
    now = F.lit(as_of).cast("timestamp")
    known = sessions.select("upload_id", F.col("total_bytes").cast("long").alias("total"), F.col("part_bytes").cast("long").alias("size"), F.coalesce("received_bytes", F.lit(0)).cast("long").alias("at"), F.unix_micros("expires_at").alias("until"), "status")
    place = [F.col("offset_bytes").cast("long").alias("offset"), F.col("length_bytes").cast("long").alias("length"), F.lower("sha256").alias("stated")]
    sent = parts.select("upload_id", F.col("sent").cast("long").alias("sent"), *place, F.col("content_bytes").cast("long").alias("came"), F.col("content_sha256").alias("digest")).join(known, "upload_id", "left")
    rows = sent.withColumn("is_part", F.lit(True)).unionByName(receipts.select("upload_id", *place).withColumn("is_part", F.lit(False)), allowMissingColumns=True)
    micros = rows.sparkSession.range(1).select(F.unix_micros(now)).first()[0]
    renewed = micros + settings.upload_session_ttl_seconds * 1_000_000
    names = ("upload_id", "is_part", "sent", "offset", "length", "stated", "came", "digest", "total", "size", "at", "until", "status")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_of, upload, seen, first = None, None, {}, True
        for batch in batches:
            out: list[tuple] = []
            for key, is_part, sent, offset, length, stated, came, digest, *session in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if first or key != now_of:
                    now_of, upload, seen, first = key, None, {}, False
                if not is_part:
                    seen[offset] = (length, stated)
                    continue
                if upload is None and session[-1] is not None:
                    upload = session
                outcome = part_outcome((offset, length, stated, came, digest), upload, seen.get(offset), micros)
                if outcome == "stored":
                    seen[offset] = (length, stated)
                    upload[2] += length
                if outcome in ("stored", "confirmed again"):
                    upload[3] = renewed
                out.append((key, sent, outcome, upload[2] if upload else 0, upload[3] if upload else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.field("upload_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["upload_id", "sent", "outcome", "next_offset", "until"])

    # Dealt by a hash of the id: by the id itself, as its two sides are dealt already, a union isn't dealt again, and then adaptive execution coalesces each side by itself.
    ordered = rows.select(*names).repartition(F.xxhash64("upload_id")).sortWithinPartitions("upload_id", "is_part", "sent")
    found = ordered.mapInArrow(fold, f"upload_id {kind}, sent long, outcome string, next_offset long, until long")
    return found.select("upload_id", "sent", "outcome", "next_offset", F.timestamp_micros("until").alias("expires_at"))


def end_sessions(sessions: DataFrame, cancelled: DataFrame, as_of: str) -> DataFrame:
    """sessions (upload_id, status, expires_at) with what becomes of them when cancelled (upload_id) asks and time passes:
    cancelled, refused (a completed one can't be cancelled), expired, or kept."""
    asked = cancelled.select("upload_id", F.lit(True).alias("_asked")).distinct()
    over = F.col("expires_at") <= F.lit(as_of).cast("timestamp")
    rows = sessions.join(asked, "upload_id", "left")
    fate = F.when(F.col("_asked") & (F.col("status") != "completed"), "cancelled").when(F.col("_asked") & ~over, "refused").when(over, "expired").otherwise("kept")
    return rows.withColumn("fate", fate).drop("_asked")


def clean_up(sessions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """One hourly run: the sessions (with temporary_storage_key and final_storage_key) that stay, and the keys of files to
    remove, as upload_id, storage_key. The final file of a completed upload belongs to its document and stays."""
    ended = sessions.withColumn("_over", F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    gone = ended.filter("_over")
    keys = F.array(F.col("temporary_storage_key"), F.when(F.col("status") != "completed", F.col("final_storage_key")))
    return ended.filter("NOT _over").drop("_over"), gone.select("upload_id", F.explode(F.array_compact(keys)).alias("storage_key"))


def orphans(files: DataFrame, sessions: DataFrame, as_of: str, grace_seconds: int = 300) -> DataFrame:
    """Files (storage_key, modified_at) that no session has, older than the grace period."""
    old = F.col("modified_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(grace_seconds))
    live = sessions.select(F.col("temporary_storage_key").alias("storage_key"))
    return files.filter(old).join(live, "storage_key", "left_anti")


def throttle_sessions(failures: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Runs of failed logins (key, ts) of one key, each within the window of the one before: how many, from when to when,
    and whether further attempts were refused."""
    runs = failures.groupBy("key", F.session_window("ts", f"{settings.login_window_seconds} seconds").alias("run"))
    found = runs.agg(F.count("*").alias("failures"), F.max("ts").alias("last_failure"))
    return found.select("key", F.col("run.start").alias("first_failure"), "last_failure", "failures", (F.col("failures") >= settings.login_attempt_limit).alias("blocked"))
