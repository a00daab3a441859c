"""Queries over uploads that are put together from their parts, and the files that stay."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators.completion import complete_uploads
from lodestone.plans.catalog import query, table
from lodestone.plans.relational_queries import AS_OF
from lodestone.session import new_path
from lodestone.sources import assembly

STEP = 700

# Documents go up in parts of 700 bytes. By turns: time over, cancelled, completed before, not all there, a part missing, a
# part altered, a part sent twice, texts named as PDF, with a zero byte, named as DOCX, Markdown and plain text. Every
# thirteenth is a document already; the installation takes a quarter as many as there are.
COMPLETED = """u AS (SELECT doc_id AS upload_id, source AS kb, doc_id % 12 AS kind, CASE WHEN doc_id % 12 = 8 THEN text || chr(0) ELSE text END AS body FROM documents WHERE length(text) > 0),
e AS (SELECT upload_id, kb, kind, strlen(body) AS total, sha256(body) AS sha, CASE WHEN kind = 0 THEN 'expired' WHEN kind = 1 THEN 'not open' WHEN kind = 2 THEN 'completed before' WHEN kind = 3 THEN 'incomplete' WHEN kind = 4 AND strlen(body) <= 700 THEN 'no file' WHEN kind IN (4, 5) THEN 'other content'
  WHEN kind = 7 AND NOT starts_with(body, '%PDF-') THEN 'not a PDF' WHEN kind = 9 THEN 'not a DOCX' WHEN kind <> 7 AND contains(body, chr(0)) THEN 'binary data' END AS early FROM u),
known AS (SELECT source AS kb, sha256(text) AS sha FROM documents WHERE length(text) > 0 AND doc_id % 13 = 0),
firsts AS (SELECT min(upload_id) AS upload_id FROM e WHERE early IS NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.kb = e.kb AND k.sha = e.sha) GROUP BY kb, sha),
placed AS (SELECT upload_id, row_number() OVER (ORDER BY upload_id) AS place FROM firsts),
room AS (SELECT (SELECT count(*) FROM documents) // 4 - (SELECT count(*) FROM known) AS free), cut AS (SELECT coalesce((SELECT upload_id FROM placed WHERE place = free), CASE WHEN free <= 0 THEN -1 ELSE 9223372036854775807 END) AS cut FROM room),
done AS (SELECT e.*, coalesce(early, CASE WHEN e.upload_id > cut THEN 'capacity' WHEN p.upload_id IS NOT NULL THEN 'completed' ELSE 'duplicate document' END) AS outcome FROM e CROSS JOIN cut LEFT JOIN placed p ON p.upload_id = e.upload_id)"""


def completed(spark: SparkSession, sf_dir: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The sessions and new documents of COMPLETED, with files under a path."""
    everything = table(spark, sf_dir, "documents")
    docs = everything.filter("length(text) > 0").select("doc_id", "source", F.pmod("doc_id", F.lit(12)).alias("kind"), F.col("text").cast("binary").alias("plain"))
    kind = F.col("kind")
    body = docs.withColumn("body", F.when(kind == 8, F.concat("plain", F.lit(b"\x00"))).otherwise(F.col("plain")))
    ending = F.when(kind == 7, ".pdf").when(kind == 9, ".docx").when(kind == 10, ".md").otherwise(".txt")
    now, total = F.lit(AS_OF).cast("timestamp"), F.octet_length("body").cast("long")
    sessions = body.select(
        F.col("doc_id").alias("upload_id"), F.col("source").alias("knowledge_base_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ending).alias("original_name"), F.sha2("body", 256).alias("declared_sha256"), total.alias("total_bytes"),
        F.when(kind == 3, total - 1).otherwise(total).alias("received_bytes"), F.when(kind == 1, "cancelled").when(kind == 2, "completed").otherwise("open").alias("status"), F.timestamp_add("MINUTE", F.when(kind == 0, 0).otherwise(5), now).alias("expires_at"),
    )
    cut = body.select("doc_id", "kind", "body", F.ceil(total / STEP).alias("n"), F.posexplode(F.sequence(F.lit(0), F.octet_length("body") - 1, F.lit(STEP))).alias("k", "offset_bytes"))
    content = F.substring("body", F.col("offset_bytes") + 1, F.lit(STEP))
    altered = F.concat(F.lit(b"\x00"), F.substring(content, F.lit(2), F.lit(STEP)))
    missing, broken, first = (kind == 4) & (F.col("k") == F.floor(F.col("n") / 2)), (kind == 5) & (F.col("k") == F.col("n") - 1), (kind == 6) & (F.col("k") == 0)
    parts = cut.filter(~missing).select(F.col("doc_id").alias("upload_id"), "offset_bytes", F.lit(1).alias("sent"), F.when(broken, altered).otherwise(content).alias("content"))
    early = cut.filter(first).select(F.col("doc_id").alias("upload_id"), "offset_bytes", F.lit(0).alias("sent"), altered.alias("content"))
    known = docs.filter("doc_id % 13 = 0").select(F.col("source").alias("knowledge_base_id"), F.sha2("plain", 256).alias("sha256"))
    return complete_uploads(sessions, parts.unionByName(early), known, path, AS_OF, Settings(max_documents=max(1, everything.count() // 4)))


@query(f"""WITH {COMPLETED} SELECT upload_id, outcome, CASE WHEN kind IN (0, 3) THEN 'open' WHEN kind = 1 THEN 'cancelled' WHEN kind = 2 OR outcome = 'completed' THEN 'completed' ELSE 'failed' END AS status, TIMESTAMP '{AS_OF}' + CASE WHEN kind = 0 THEN INTERVAL 0 SECOND WHEN kind < 4 THEN INTERVAL 300 SECOND ELSE INTERVAL 86400 SECOND END AS expires_at,
  CASE WHEN outcome = 'completed' THEN 'pending' END AS document_status, CASE WHEN outcome <> 'completed' THEN NULL WHEN kind = 7 THEN 'application/pdf' WHEN kind = 10 THEN 'text/markdown' ELSE 'text/plain' END AS media_type,
  CASE WHEN outcome = 'completed' THEN total END AS size_bytes, CASE WHEN outcome = 'completed' THEN sha END AS sha256, outcome = 'completed' AS intact FROM done""")
def assembled_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completing uploads from their parts comes to, with the documents made; their files are read back."""
    path = new_path(spark, "assembled")
    states, made = completed(spark, sf_dir, path)
    back = assembly.hash_files(made, path).select("storage_key", F.col("sha256").alias("read"))
    docs = made.join(back, "storage_key", "left").select("document_id", F.col("status").alias("document_status"), "media_type", "size_bytes", "sha256", (F.col("read") == F.col("sha256")).alias("intact"))
    rows = states.join(docs, "document_id", "left").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    return rows.select("upload_id", "outcome", "status", "expires_at", "document_status", "media_type", "size_bytes", "sha256", F.coalesce("intact", F.lit(False)).alias("intact"))


@query(f"""WITH {COMPLETED} SELECT sha AS file, count(*) AS n_documents FROM done WHERE outcome = 'completed' GROUP BY 1 UNION ALL SELECT 'removed by the second sweep', 0""")
def swept_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are left after two sweeps: those of documents, and how many each has."""
    path = new_path(spark, "swept-uploads")
    _, made = completed(spark, sf_dir, path)
    later = datetime.now() + timedelta(days=1)
    assembly.sweep_files(spark, path, made, later)
    again = assembly.sweep_files(spark, path, made, later)
    left = assembly.files_there(spark, path).select(F.regexp_extract("storage_key", "[^/]*$", 0).alias("file")).distinct()
    n = made.groupBy(F.col("sha256").alias("file")).agg(F.count("*").alias("n_documents"))
    found = left.join(n, "file", "full_outer").select("file", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    return found.unionByName(again.agg(F.count("*").alias("n_documents")).select(F.lit("removed by the second sweep").alias("file"), "n_documents"))
