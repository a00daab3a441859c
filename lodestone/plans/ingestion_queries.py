"""Queries over ingestion: files to sections, chunks, vectors and what is published."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lodestone.config import DEFAULTS, Settings
from lodestone.operators import embedding, lifecycle, snapshots
from lodestone.operators.chunking import chunk_guard, chunk_sections
from lodestone.plans.catalog import ORACLES, query, table
from lodestone.plans.retrieval_queries import CHUNKS_SQL, WHITE
from lodestone.session import new_path
from lodestone.sources import sink
from lodestone.sources.formats import WORD_SPACE, extract_documents

BATCH = DEFAULTS.embedding_batch_size


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """The lines of texts as the paragraphs of DOCX files."""

    def pack(text: str) -> bytes:
        escape = lambda x: re.sub("[^\t -퟿-�\U00010000-\U0010ffff]", "", x).replace("&", "&amp;").replace("<", "&lt;")
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as archive:
            archive.writestr("[Content_Types].xml", "<Types/>")
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{WORD_SPACE[1:-1]}"><w:body>{body}</w:body></w:document>')
        return file.getvalue()

    return texts.map(lambda t: pack(t) if t is not None else None)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by turns: plain text, Markdown, DOCX, and one with an ending that isn't allowed."""
    kind = F.pmod("doc_id", F.lit(4))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    suffix = F.when(F.col("kind") == 0, ".txt").when(F.col("kind") == 1, ".md").when(F.col("kind") == 2, ".docx").otherwise(".html")
    content = F.when(F.col("kind") == 2, packed(F.when(F.col("kind") == 2, F.col("text")))).otherwise(F.col("text").cast("binary"))
    return docs.select("document_id", suffix.alias("suffix"), content.alias("content"))


SECTIONS_SQL = f"""lines AS (SELECT doc_id, doc_id % 4 AS kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 4 < 3),
marked AS (SELECT *, trim(line, {WHITE}) = '' AS blank, lag(trim(line, {WHITE}) = '', 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS after_blank, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS heading FROM lines),
parts AS (SELECT *, CASE kind WHEN 0 THEN sum(CASE WHEN NOT blank AND after_blank THEN 1 ELSE 0 END) OVER w WHEN 1 THEN sum(heading::INTEGER) OVER w ELSE i END AS g FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
joined AS (SELECT doc_id, kind, g, trim(string_agg(line, chr(10) ORDER BY i), {WHITE}) AS text FROM parts WHERE kind <> 0 OR NOT blank GROUP BY 1, 2, 3),
sections AS (SELECT doc_id AS document_id, kind, doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY g) AS doc_id, text FROM joined WHERE text <> '')"""


@query(f"""WITH {SECTIONS_SQL}, n AS (SELECT document_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM sections GROUP BY 1)
SELECT d.doc_id AS document_id, ['text/plain', 'text/markdown', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', NULL][d.doc_id % 4 + 1] AS media_type,
  CASE WHEN d.doc_id % 4 = 3 THEN 'suffix' WHEN n IS NULL THEN 'no text' END AS error, coalesce(n, 0) AS n_sections, coalesce(n.n_chars, 0) AS n_chars FROM documents d LEFT JOIN n ON n.document_id = d.doc_id""")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files of four kinds hold."""
    found, sections = extract_documents(files(spark, sf_dir))
    n = sections.groupBy("document_id").agg(F.count("*").alias("n_sections"), F.sum(F.char_length("text")).alias("n_chars"))
    joined = found.join(n, "document_id", "left")
    return joined.select("document_id", "media_type", "error", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


INGEST_SQL = CHUNKS_SQL.replace("WITH RECURSIVE docs AS", f"WITH RECURSIVE {SECTIONS_SQL}, docs AS").replace("FROM documents WHERE trim(text", "FROM sections WHERE trim(text")


@query(INGEST_SQL + """, n AS (SELECT document_id // 1000000 AS doc_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT d.doc_id AS document_id, coalesce(n, 0) AS n_chunks, CASE WHEN coalesce(n, 0) BETWEEN 1 AND 5000 AND d.doc_id % 10 <> 4 THEN 'ready' ELSE 'failed' END AS status,
  CASE WHEN coalesce(n, 0) BETWEEN 1 AND 5000 AND d.doc_id % 10 <> 4 THEN n ELSE 0 END AS n_published FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to published chunks with vectors; some documents lack a vector, and fail."""
    found, sections = extract_documents(files(spark, sf_dir))
    chunks = chunk_sections(sections.select("document_id", "section_no", "text"))
    judged = chunk_guard(found.select("document_id"), chunks)
    vectors = chunks.filter((F.col("ordinal") > 0) | (F.col("document_id") % 10 != 4)).select("document_id", "ordinal", F.array(F.char_length("text").cast("float"), F.lit(1.0)).alias("embedding"))
    whole, errors = lifecycle.with_vectors(chunks, vectors)
    status = lifecycle.published(F.lit("processing"), F.coalesce("safe_error", "_error"))
    states = judged.join(errors.select("document_id", F.col("error").alias("_error")), "document_id", "left").select("document_id", "n_chunks", status.alias("status"))
    published = lifecycle.publish_chunks(whole.drop("section_no", "part"), states, new_path(spark, "chunks"))
    n = published.groupBy("document_id").agg(F.count("embedding").alias("n_published"))
    return states.join(n, "document_id", "left").select("document_id", "n_chunks", "status", F.coalesce("n_published", F.lit(0)).alias("n_published"))


@query("""WITH old AS (SELECT doc_id, unnest(generate_series(0, (length(text) - 1) // 200)) AS ordinal, text FROM documents WHERE length(text) > 0),
new AS (SELECT doc_id, unnest(generate_series(0, (length(text) - 1) // 500)) AS ordinal, text FROM documents WHERE length(text) > 0 AND doc_id % 3 = 0 AND doc_id % 9 <> 0)
SELECT doc_id AS document_id, ordinal::INTEGER AS ordinal, md5(substr(text, ordinal * 200 + 1, 200)) AS digest FROM old WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, ordinal::INTEGER, md5(substr(text, ordinal * 500 + 1, 500)) FROM new""")
def publish_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are published, then every third again with other chunks, of which every third has failed; the others,
    which share their folders, keep what they have."""
    path = new_path(spark, "published")
    twice_published(spark, sf_dir, path)
    return snapshots.snapshot(spark, path)


def twice_published(spark: SparkSession, sf_dir: str, path: str) -> None:
    docs = table(spark, sf_dir, "documents").filter("length(text) > 0").select(F.col("doc_id").alias("document_id"), "text")

    def cut(rows: DataFrame, size: int) -> DataFrame:
        parts = rows.select("document_id", "text", F.posexplode(F.sequence(F.lit(1), F.char_length("text"), F.lit(size))).alias("ordinal", "at"))
        return parts.select("document_id", "ordinal", F.md5(F.substring("text", F.col("at"), F.lit(size)).cast("binary")).alias("digest"))

    again = docs.filter("document_id % 3 = 0")
    snapshots.publish(cut(docs, 200), docs.select("document_id", F.lit("ready").alias("status")), path, 0)
    snapshots.publish(cut(again, 500), again.select("document_id", F.when(F.col("document_id") % 9 == 0, "failed").otherwise("ready").alias("status")), path, 1)


CHANGES_SQL = """SELECT doc_id AS document_id, (length(text) + 199) // 200 AS n_before, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE (length(text) + 499) // 500 END AS n_after,
  CASE WHEN doc_id % 9 = 0 THEN 'removed' WHEN length(text) <= 200 THEN 'same' ELSE 'replaced' END AS change FROM documents WHERE length(text) > 0 AND doc_id % 3 = 0"""


@query(CHANGES_SQL)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second of two batches has changed."""
    path = new_path(spark, "compared")
    twice_published(spark, sf_dir, path)
    return snapshots.changes(spark, path, 1, 2)


@query(ORACLES["publish_chunks"])
def compacted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after compaction, and after all that only older versions need is swept away."""
    path = new_path(spark, "compacted")
    twice_published(spark, sf_dir, path)
    snapshots.compact(spark, path)
    snapshots.sweep(spark, path, keep=1, older_than_ms=0)
    return snapshots.snapshot(spark, path)


SIZED = Settings(embedding_dimension=64)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as providers' responses, eight to each: in order, backwards, wrongly numbered, one too short, one left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / BATCH).alias("request_id"), (F.col("vec_id") % BATCH).cast("int").alias("place"), "embedding")
    kind = F.pmod("request_id", F.lit(5))
    short = F.when((kind == 3) & (F.col("place") == 0), F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    item = F.struct((F.col("place") + F.when(kind == 2, 1).otherwise(0)).alias("index"), short.alias("embedding"))
    grouped = rows.withColumn("item", item).groupBy("request_id").agg(F.count("*").alias("n_texts"), F.sort_array(F.collect_list("item")).alias("items"))
    said = F.when(kind == 1, F.reverse("items")).when(kind == 4, F.slice("items", 1, F.size("items") - 1)).otherwise(F.col("items"))
    return grouped.select("request_id", "n_texts", F.to_json(F.struct(F.struct(said.alias("embeddings")).alias("output"))).alias("body"))


@query(f"SELECT DISTINCT vec_id // {BATCH} AS request_id, CASE (vec_id // {BATCH}) % 5 WHEN 2 THEN 'index' WHEN 3 THEN 'dimension' WHEN 4 THEN 'count' END AS error FROM embeddings")
def embedding_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each response, if anything."""
    return embedding.read_responses(responses(spark, sf_dir), SIZED)[0]


@query(f"SELECT vec_id // {BATCH} AS request_id, (vec_id % {BATCH})::INTEGER AS position, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings WHERE (vec_id // {BATCH}) % 5 < 2")
def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of sound responses, in the order of their texts."""
    rows = embedding.read_responses(responses(spark, sf_dir), SIZED)[1]
    at = lambda k: F.round(F.element_at("embedding", k).cast("float").cast("double"), 5)
    return rows.select("request_id", "position", at(1).alias("first"), at(64).alias("last"))


STORED_BYTES = 4_000


@query(f"""WITH d AS (SELECT doc_id AS file_id, strlen(coalesce(text, '')) AS size, text, ['text/plain', 'text/markdown', 'text/markdown', NULL][doc_id % 4 + 1] AS media_type FROM documents),
e AS (SELECT *, CASE WHEN media_type IS NULL THEN 'suffix' WHEN size > {STORED_BYTES} THEN 'too large' WHEN size = 0 THEN 'empty' WHEN contains(text, chr(0)) THEN 'binary data' END AS error FROM d)
SELECT file_id, 'doc' || file_id || ['.txt', '.md', '.MARKDOWN', '.html'][file_id % 4 + 1] AS original_name, media_type, CASE WHEN error IS NULL THEN size END AS size_bytes, CASE WHEN error IS NULL THEN sha256(text) END AS sha256, error, error IS NULL AS intact FROM e""")
def one_shot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as files and read back; those that are too long, empty or of a wrong kind leave nothing."""
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".MARKDOWN", ".html"))), (F.col("doc_id") % 4 + 1).cast("int"))
    uploads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("C:\\files\\doc"), F.col("doc_id").cast("string"), ending).alias("name"), F.col("text").cast("binary").alias("content"))
    path = new_path(spark, "stored-files")
    kept = sink.store_files(uploads, path, STORED_BYTES)
    back = sink.stored_content(spark, path).select("storage_key", F.sha2("content", 256).alias("_sha256"), F.octet_length("content").alias("_size"))
    rows = kept.join(back, "storage_key", "left")
    intact = F.coalesce((F.col("_sha256") == F.col("sha256")) & (F.col("_size") == F.col("size_bytes")), F.lit(False))
    return rows.select("file_id", "original_name", "media_type", "size_bytes", "sha256", "error", intact.alias("intact"))
