"""Queries over what people see: listings with places, parts of answers, citations as they are sent, new conversations, and
the guards of packed files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lodestone.operators import access, conversations, listings
from lodestone.plans.catalog import query, table
from lodestone.plans.conversation_queries import ALL_CITATIONS, MESSAGES, all_citations, messages, ready
from lodestone.plans.relational_queries import AS_OF, OWNED, UPLOADS, USERS, all_uploads, grants, knowledge_bases, owned, users
from lodestone.sources.formats import WORD_SPACE, extract_documents

DAY = "2023-01-01 00:00:00"


def day(number: Column) -> Column:
    return F.timestamp_add("DAY", number.cast("int"), F.lit(DAY).cast("timestamp"))


def plain_times(rows: DataFrame) -> DataFrame:
    """Times as they are written, for comparing."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"})


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).withColumns({"created_at": day(F.col("user_id") % 300), "password_hash": F.lit("hidden")})


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("knowledge_base_id")
    return knowledge_bases(spark, sf_dir).filter(key.isNotNull()).select(key, F.reverse(key).alias("name"), F.lit(None).cast("string").alias("description"), F.lit(DAY).cast("timestamp").alias("created_at"))


@query(f"WITH {USERS} SELECT user_id, username, is_administrator, is_enabled, TIMESTAMP '{DAY}' + to_days((user_id % 300)::INTEGER) AS created_at, row_number() OVER (ORDER BY username, user_id) AS place FROM users")
def user_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users by name, without what is not to be shown."""
    return plain_times(listings.list_users(people(spark, sf_dir)))


BASES = f"bases AS (SELECT DISTINCT source AS knowledge_base_id, reverse(source) AS name, NULL::VARCHAR AS description, TIMESTAMP '{DAY}' AS created_at FROM documents WHERE source IS NOT NULL)"


@query(f"WITH {BASES} SELECT *, row_number() OVER (ORDER BY name, knowledge_base_id) AS place FROM bases")
def knowledge_base_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(listings.list_knowledge_bases(bases(spark, sf_dir)))


@query(f"""WITH {USERS}, {BASES}, seen AS (SELECT DISTINCT g.user_id, g.knowledge_base_id FROM grants g JOIN users u ON u.user_id = g.user_id WHERE is_enabled AND NOT is_administrator)
SELECT user_id, b.*, row_number() OVER (PARTITION BY user_id ORDER BY name, b.knowledge_base_id) AS place FROM seen JOIN bases b ON b.knowledge_base_id = seen.knowledge_base_id""")
def accessible_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge bases that each plain user may see, by name."""
    plain = people(spark, sf_dir).filter("NOT is_administrator")
    rows = bases(spark, sf_dir)
    return plain_times(listings.list_accessible(access.accessible(plain, rows, grants(spark, sf_dir)), rows))


@query(f"""SELECT doc_id AS document_id, source AS knowledge_base_id, 'doc' || doc_id || '.txt' AS original_name, 'text/plain' AS media_type, n_chars AS size_bytes, NULL::INTEGER AS page_count, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'unreadable' END AS safe_error,
  TIMESTAMP '{DAY}' + to_days((doc_id % 90)::INTEGER) AS created_at, TIMESTAMP '{AS_OF}' AS updated_at, row_number() OVER (PARTITION BY source ORDER BY doc_id % 90 DESC, doc_id) AS place FROM documents""")
def documents_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each knowledge base, latest first."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        key.alias("document_id"), F.col("source").alias("knowledge_base_id"), F.concat(F.lit("doc"), key.cast("string"), F.lit(".txt")).alias("original_name"), F.lit("text/plain").alias("media_type"), F.col("n_chars").alias("size_bytes"), F.lit(None).cast("int").alias("page_count"),
        F.when(key % 5 == 0, "failed").otherwise("ready").alias("status"), F.when(key % 5 == 0, "unreadable").alias("safe_error"), day(key % 90).alias("created_at"), F.lit(AS_OF).cast("timestamp").alias("updated_at"), F.lit("hidden").alias("storage_key"),
    )
    return plain_times(listings.list_documents(rows))


@query(f"""WITH {UPLOADS} SELECT upload_id, knowledge_base_id, initiated_by_id, c_name AS initiated_by_username, 'u.txt' AS original_name, declared_sha256, total_bytes, received_bytes, 5242880 AS part_size_bytes, status, NULL::VARCHAR AS safe_error, NULL::VARCHAR AS resulting_document_id, expires_at,
  expires_at - INTERVAL 86400 SECOND AS created_at, expires_at - INTERVAL 86400 SECOND AS updated_at, row_number() OVER (PARTITION BY knowledge_base_id ORDER BY expires_at DESC, upload_id) AS place
FROM uploads LEFT JOIN customer ON c_custkey = initiated_by_id WHERE status <> 'completed' AND expires_at > TIMESTAMP '{AS_OF}'""")
def upload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads under way of each knowledge base, latest first."""
    began = F.col("expires_at") - F.make_dt_interval(secs=F.lit(86_400))
    nothing = F.lit(None).cast("string")
    rows = all_uploads(spark, sf_dir).withColumns({"original_name": F.lit("u.txt"), "part_size_bytes": F.lit(5_242_880), "safe_error": nothing, "resulting_document_id": nothing, "created_at": began, "updated_at": began, "temporary_storage_key": F.lit("hidden")})
    return plain_times(listings.list_uploads(rows, people(spark, sf_dir), AS_OF))


@query(f"WITH {MESSAGES} SELECT conversation_id, id AS message_id, sequence, role, status, content, created_at, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence, id) AS place FROM messages")
def message_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each conversation in their order."""
    return plain_times(listings.list_messages(messages(spark, sf_dir).withColumnRenamed("id", "message_id")))


def shown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.available_citations(all_citations(spark, sf_dir), ready(spark, sf_dir))
    key = F.col("document_id")
    return rows.withColumns({
        "document_name": F.concat(F.lit('"doc" '), key.cast("string")), "locator": F.struct(F.when(key % 2 == 0, key).alias("page"), F.when(key % 3 == 0, "Part").alias("section")), "excerpt": F.concat(F.lit("line\n"), key.cast("string")),
        "retrieval_rank": F.lit(4) - F.col("citation_number"), "retrieval_score": F.when(F.col("citation_number") != 2, F.col("citation_number") / 4),
    })


CITATION = """'"doc" ' || c.document_id AS document_name, 4 - citation_number AS retrieval_rank, CASE WHEN citation_number <> 2 THEN citation_number / 4 END AS retrieval_score, source_available, CASE WHEN source_available THEN '/citations/' || citation_id || '/source' END AS source_url"""


@query(f"""WITH {ALL_CITATIONS} SELECT message_id, citation_id, {CITATION}, CASE WHEN document_id % 2 = 0 THEN document_id END AS page, CASE WHEN document_id % 3 = 0 THEN 'Part' END AS section, 'line' || chr(10) || document_id AS excerpt, row_number() OVER (PARTITION BY message_id ORDER BY 4 - citation_number, citation_id) AS place FROM citations c""")
def citation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of each message by rank."""
    rows = listings.list_citations(shown_citations(spark, sf_dir))
    return rows.select("*", "locator.page", "locator.section").drop("locator")


@query(f"""WITH {ALL_CITATIONS} SELECT citation_id::VARCHAR AS id, {CITATION}, 'line' || chr(10) || document_id AS excerpt, CASE WHEN document_id % 2 = 0 THEN document_id END AS page, 8 AS n_fields FROM citations c""")
def citation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as they are sent, read back."""
    rows = conversations.citation_payloads(shown_citations(spark, sf_dir))
    kind = "id string, document_name string, locator struct<page: long, section: string>, excerpt string, retrieval_rank int, retrieval_score double, source_available boolean, source_url string"
    read = rows.select(F.from_json("payload", kind).alias("p"), F.size(F.json_object_keys("payload")).alias("n_fields"))
    return read.select("p.id", "p.document_name", "p.locator.page", "p.excerpt", "p.retrieval_rank", "p.retrieval_score", "p.source_available", "p.source_url", "n_fields")


@query(r"""WITH c AS (SELECT doc_id, replace(text, 'e ', 'e [1][3] [9] ') AS content FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, string_split_regex(content, '\[\d+\]') AS t, regexp_extract_all(content, '\[\d+\]') AS m FROM c),
p AS (SELECT doc_id, 2 * i AS place, t[i + 1] AS part, NULL AS mark FROM (SELECT *, unnest(generate_series(0, len(t) - 1)) AS i FROM s) UNION ALL SELECT doc_id, 2 * i + 1, m[i + 1], m[i + 1] FROM (SELECT *, unnest(generate_series(0, len(m) - 1)) AS i FROM s WHERE len(m) > 0))
SELECT doc_id AS turn_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INTEGER AS n, md5(part) AS part, CASE mark WHEN '[1]' THEN 1 WHEN '[3]' THEN 3 END::INTEGER AS marker, CASE mark WHEN '[1]' THEN 'E2' WHEN '[3]' THEN 'E5' END AS evidence_id FROM p WHERE part <> ''""")
def marked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with markers in them as answers, in parts: two markers side by side, and one that stands for nothing."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("turn_id"), F.replace("text", F.lit("e "), F.lit("e [1][3] [9] ")).alias("content"), F.array(*map(F.lit, ("E2", "E1", "E5"))).alias("used"))
    return conversations.marked_parts(answers).withColumn("part", F.md5(F.col("part").cast("binary")))


@query(f"""WITH {USERS}, {OWNED}, asked AS (SELECT conversation_id AS request_id, owner_id, 'src' || (conversation_id % 30) AS knowledge_base_id FROM owned),
judged AS (SELECT request_id, CASE WHEN knowledge_base_id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) THEN 'no knowledge base' WHEN EXISTS (SELECT 1 FROM users u WHERE u.user_id = owner_id AND is_administrator AND is_enabled) OR EXISTS (SELECT 1 FROM grants g WHERE g.user_id = owner_id AND g.knowledge_base_id = asked.knowledge_base_id) THEN 'created' ELSE 'no access' END AS outcome FROM asked)
SELECT request_id, outcome, CASE WHEN outcome = 'created' THEN 'New Conversation' END AS title FROM judged""")
def conversation_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests for a conversation are met; some name a knowledge base that isn't there, or isn't theirs."""
    asked = owned(spark, sf_dir).select(F.col("conversation_id").alias("request_id"), "owner_id", F.concat(F.lit("src"), (F.col("conversation_id") % 30).cast("string")).alias("knowledge_base_id"))
    found, made = conversations.create_conversations(asked, knowledge_bases(spark, sf_dir), grants(spark, sf_dir), users(spark, sf_dir), AS_OF)
    keyed = found.select("request_id", "outcome", F.when(F.col("outcome") == "created", conversations.row_id(F.lit("conversation"), F.col("request_id"))).alias("conversation_id"))
    return keyed.join(made.select("conversation_id", "title"), "conversation_id", "left").select("request_id", "outcome", "title")


@F.pandas_udf(BinaryType())
def paged(keys: pd.Series) -> pd.Series:
    """DOCX files that say how many pages they have, by key: more than may be, none, nonsense, nothing; and large ones."""

    def pack(key: int) -> bytes:
        file = io.BytesIO()
        says = {0: str(key % 400), 1: "501", 2: "", 3: "many"}.get(key % 6)
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("[Content_Types].xml", "<Types/>")
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{WORD_SPACE[1:-1]}"><w:body><w:p><w:r><w:t>{key}</w:t></w:r></w:p></w:body></w:document>')
            if says is not None:
                archive.writestr("docProps/app.xml", f'<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Pages>{says}</Pages></Properties>')
            if key % 6 == 5:
                archive.writestr("word/media/blank.bin", b"\x00" * 20_000)
        return file.getvalue()

    return keys.map(pack)


@query("""SELECT doc_id AS document_id, CASE WHEN doc_id % 6 <> 5 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS media_type, CASE doc_id % 6 WHEN 0 THEN doc_id % 400 WHEN 1 THEN 501 END::INTEGER AS page_count,
  CASE doc_id % 6 WHEN 1 THEN 'too many pages' WHEN 5 THEN 'expands too far' END AS error, CASE WHEN doc_id % 6 IN (1, 5) THEN 0 ELSE 1 END AS n_sections FROM documents""")
def docx_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files with a page count, too many pages, or members that are too large together (here: above 10,000 bytes)."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(".docx").alias("suffix"), paged("doc_id").alias("content"))
    found, sections = extract_documents(files, max_expanded=10_000)
    n = sections.groupBy("document_id").agg(F.count("*").alias("n_sections"))
    return found.join(n, "document_id", "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
