"""Completing uploads: their parts become files, and these become documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.ids import row_id
from lodestone.functions.text import safe_name, suffix
from lodestone.sources.assembly import assemble
from lodestone.sources.formats import media_type

#: Outcomes after which a session can't be taken up again, besides those of a wrong format.
UNCHANGED = ("completed before", "not open", "expired", "incomplete")


def complete_uploads(sessions: DataFrame, parts: DataFrame, documents: DataFrame, path: str, as_of: str, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Completes sessions in order of upload_id, with files stored under a path. Returns upload_id, outcome, status,
    expires_at and document_id of each, and the new documents: document_id, knowledge_base_id, original_name, storage_key,
    sha256, media_type, size_bytes, status.

    sessions: upload_id (a number, the key), knowledge_base_id, original_name, declared_sha256, total_bytes, received_bytes,
    status, expires_at; parts: upload_id, offset_bytes, sent, content, as assemble() takes them; documents:
    knowledge_base_id, sha256. Outcomes in order of precedence: completed before, not open, expired, incomplete, no file,
    other content, what is wrong with the format, capacity, duplicate document, completed. The first four leave a session
    as it was. All others but the last make it a failed one; both these and the completed are renewed. Digest, size and
    format are those of the bytes that came, not what anyone says of them. A status or count that is null is open, or
    zero; a session without an end has ended.

    Only parts of sessions that may complete are read into files. Files of what then meets capacity or a duplicate belong
    to no document, so that sweep_files() removes them. Capacity takes the smallest new uploads up to the free places, in
    one task where there are more than these.
    """
    now = F.lit(as_of).cast("timestamp")
    early = (
        F.when(F.col("status") == "completed", "completed before")
        .when(F.coalesce("status", F.lit("open")) != "open", "not open")
        .when(F.col("expires_at").isNull() | (F.col("expires_at") <= now), "expired")
        .when(~F.coalesce("received_bytes", F.lit(0)).eqNullSafe(F.col("total_bytes")), "incomplete")
    )
    rows = sessions.select("upload_id", "knowledge_base_id", "original_name", F.lower("declared_sha256").alias("sha256"), "total_bytes", "status", "expires_at", early.alias("early"))
    waiting = rows.filter("early IS NULL").select(F.col("upload_id").alias("file_id"), suffix(F.col("original_name")).alias("suffix"), "total_bytes", F.col("sha256").alias("declared_sha256"))
    files = assemble(waiting, parts.withColumnRenamed("upload_id", "file_id"), path)
    found = files.select(F.col("file_id").alias("upload_id"), "storage_key", F.col("error").alias("file_error"), F.lit(True).alias("has_file"))
    late = F.when(F.col("has_file").isNull(), "no file").otherwise(F.col("file_error"))
    kind = media_type(suffix(F.col("original_name")))
    judged = rows.join(found, "upload_id", "left").withColumn("outcome", F.coalesce("early", late, F.when(kind.isNull(), "suffix")))

    sound = judged.filter("outcome IS NULL")
    there = documents.select("knowledge_base_id", F.lower("sha256").alias("sha256")).distinct()
    firsts = sound.join(there, ["knowledge_base_id", "sha256"], "left_anti").groupBy("knowledge_base_id", "sha256").agg(F.min("upload_id").alias("upload_id"))
    free = max(0, settings.max_documents - documents.count())
    full = F.lit(free == 0)
    if free and firsts.count() >= free:
        full = F.col("upload_id") > firsts.orderBy("upload_id").limit(free).agg(F.max("upload_id")).first()[0]
    new = firsts.select("upload_id", F.lit(True).alias("is_first"))
    last = F.when(full, "capacity").when(F.col("is_first"), "completed").otherwise("duplicate document")
    done = judged.join(new, "upload_id", "left").withColumn("outcome", F.coalesce("outcome", last))
    kept, completed = F.col("outcome").isin(*UNCHANGED), F.col("outcome") == "completed"
    renewed = now + F.make_dt_interval(secs=F.lit(settings.upload_session_ttl_seconds))
    document = F.when(completed, row_id(F.col("upload_id")))
    states = done.select("upload_id", "outcome", F.when(kept, F.col("status")).when(completed, "completed").otherwise("failed").alias("status"), F.when(kept, F.col("expires_at")).otherwise(renewed).alias("expires_at"), document.alias("document_id"))
    made = done.filter(completed).select(document.alias("document_id"), "knowledge_base_id", safe_name(F.col("original_name")).alias("original_name"), "storage_key", "sha256", kind.alias("media_type"), F.col("total_bytes").alias("size_bytes"), F.lit("pending").alias("status"))
    return states, made
