"""Queries over users, knowledge bases, documents, uploads and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.text import file_size, progress, safe_name, suffix
from lodestone.operators import access, lifecycle, uploads
from lodestone.plans.catalog import ORACLES, query, table
from lodestone.sources.formats import decoded, markdown_sections, media_type, sniff
from lodestone.sources.formats import text_sections as sections_of

AS_OF = "2024-01-20 00:00:00"

# Users are customers (every seventh an administrator, every eleventh disabled), each granted three knowledge bases.
USERS = """users AS (SELECT c_custkey AS user_id, c_name AS username, c_custkey % 7 = 0 AS is_administrator, c_custkey % 11 <> 0 AS is_enabled, (c_custkey % 3 + 1)::INTEGER AS session_version FROM customer),
kbs AS (SELECT DISTINCT source AS knowledge_base_id FROM documents),
grants AS (SELECT DISTINCT c_custkey AS user_id, 'src' || (c_custkey * i % 25) AS knowledge_base_id FROM customer, (SELECT unnest([1, 3, 7]) AS i))"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("user_id"), F.col("c_name").alias("username"), (key % 7 == 0).alias("is_administrator"), (key % 11 != 0).alias("is_enabled"), (key % 3 + 1).cast("int").alias("session_version"))


def knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("knowledge_base_id")).distinct()


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*map(F.lit, (1, 3, 7)))).alias("i"))
    return rows.select("user_id", F.concat(F.lit("src"), (F.col("user_id") * F.col("i") % 25).cast("string")).alias("knowledge_base_id")).distinct()


@query(f"""WITH {USERS} SELECT u.user_id, g.knowledge_base_id FROM users u JOIN grants g USING (user_id) JOIN kbs k ON k.knowledge_base_id = g.knowledge_base_id WHERE is_enabled AND NOT is_administrator
UNION ALL SELECT user_id, knowledge_base_id FROM users, kbs WHERE is_enabled AND is_administrator""")
def accessible_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.accessible(users(spark, sf_dir), knowledge_bases(spark, sf_dir), grants(spark, sf_dir))


OWNED = "owned AS (SELECT o_orderkey AS conversation_id, o_custkey AS owner_id, 'src' || (o_orderkey % 25) AS knowledge_base_id, o_orderdate AS updated_at FROM orders)"


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversations of their customers."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("owner_id"), F.concat(F.lit("src"), (F.col("o_orderkey") % 25).cast("string")).alias("knowledge_base_id"), F.col("o_orderdate").alias("updated_at"))


@query(f"WITH {USERS}, {OWNED} SELECT conversation_id, owner_id FROM owned o WHERE EXISTS (SELECT 1 FROM grants g WHERE g.user_id = o.owner_id AND g.knowledge_base_id = o.knowledge_base_id)")
def access_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose owners may still see their knowledge base."""
    return access.visible(owned(spark, sf_dir), grants(spark, sf_dir)).select("conversation_id", "owner_id")


@query(f"WITH {USERS}, {OWNED} SELECT owner_id, count(*) AS n_conversations, max(updated_at) AS last_update FROM owned o WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.user_id = o.owner_id AND g.knowledge_base_id = o.knowledge_base_id) GROUP BY 1")
def revoked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access.revoked(owned(spark, sf_dir), grants(spark, sf_dir))
    return rows.groupBy("owner_id").agg(F.count("*").alias("n_conversations"), F.max("updated_at").alias("last_update"))


@query("""WITH named AS (SELECT 'src' || range AS knowledge_base_id FROM range(40)), live AS (SELECT DISTINCT 'src' || (user_id % 35) AS knowledge_base_id FROM events WHERE event_type = 'error' AND user_id % 2 = 1)
SELECT knowledge_base_id FROM named WHERE knowledge_base_id NOT IN (SELECT source FROM documents) AND knowledge_base_id NOT IN (SELECT knowledge_base_id FROM live)""")
def deletable_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of forty knowledge bases, those without documents and without an upload under way."""
    named = spark.range(40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("knowledge_base_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("knowledge_base_id"))
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    live = events.select(F.concat(F.lit("src"), (F.col("user_id") % 35).cast("string")).alias("knowledge_base_id"), F.when(F.col("user_id") % 2 == 1, "open").otherwise("completed").alias("status"))
    return access.deletable(named, docs, live)


@query(f"""WITH {USERS} SELECT user_id, CASE WHEN user_id % 7 = 0 THEN is_enabled ELSE user_id % 4 <> 0 END AS is_enabled, is_administrator,
  session_version + CASE WHEN user_id % 7 <> 0 AND is_enabled AND user_id % 4 = 0 THEN 1 ELSE 0 END::INTEGER AS session_version,
  CASE WHEN user_id % 7 = 0 THEN CASE WHEN is_enabled AND user_id % 5 < 6 THEN 'last administrator' ELSE 'changed' END WHEN is_enabled <> (user_id % 4 <> 0) THEN 'changed' ELSE 'same' END AS outcome FROM users WHERE user_id % 7 <> 0 OR is_enabled
UNION ALL SELECT user_id, false, true, session_version, 'same' FROM users WHERE user_id % 7 = 0 AND NOT is_enabled""")
def last_admin_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All administrators are to be disabled, which is refused; of the others, some are, which goes through."""
    rows = users(spark, sf_dir)
    on = F.when(F.col("is_administrator"), False).otherwise(F.col("user_id") % 4 != 0)
    return access.change_users(rows, rows.select("user_id", on.alias("is_enabled"), F.lit(None).cast("boolean").alias("is_administrator")))


@query(f"""WITH {USERS} SELECT event_id, e.user_id, coalesce(is_enabled AND (e.user_id % 2 + 1) = session_version AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 28800 SECOND, false) AS valid FROM events e LEFT JOIN users u ON u.user_id = e.user_id""")
def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions: which are still good."""
    sessions = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 2 + 1).alias("version"), F.col("ts").alias("issued_at"))
    return access.valid_sessions(sessions, users(spark, sf_dir), AS_OF, DEFAULTS.session_max_age_seconds).select("event_id", "user_id", "valid")


@query("SELECT c_mktsegment AS segment, lower(c_name) AS username, c_custkey AS user_id, regexp_matches(lower(c_name), '^[a-z0-9#._-]{3,64}$') AS valid FROM customer WHERE lower(c_name) = 'customer#' || lpad(c_custkey::VARCHAR, 9, '0')")
def username_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by name whatever its case, and whether the name is one that may be given."""
    name = F.lower("c_name")
    rows = table(spark, sf_dir, "customer").filter(name == F.concat(F.lit("customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    return rows.select(F.col("c_mktsegment").alias("segment"), name.alias("username"), F.col("c_custkey").alias("user_id"), name.rlike("^[a-z0-9#._-]{3,64}$").alias("valid"))


@query(f"""WITH {USERS} SELECT knowledge_base_id, string_agg(knowledge_base_id || ':' || user_id, ' ' ORDER BY user_id) AS keys, count(*) AS n FROM grants GROUP BY 1""")
def grant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grants(spark, sf_dir)
    keys = F.transform(F.sort_array(F.collect_list("user_id")), lambda u: F.concat(F.col("knowledge_base_id"), F.lit(":"), u.cast("string")))
    return rows.groupBy("knowledge_base_id").agg(F.array_join(keys, " ").alias("keys"), F.count("*").alias("n"))


@query(f"WITH {USERS} SELECT knowledge_base_id, user_id, knowledge_base_id || ':' || user_id AS key FROM grants")
def grant_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all grants, a row each."""
    return grants(spark, sf_dir).select("knowledge_base_id", "user_id", F.concat("knowledge_base_id", F.lit(":"), F.col("user_id").cast("string")).alias("key"))


# Uploads are orders: their price in hundreds of bytes is the size, and what has arrived goes by their status.
UPLOADS = f"""uploads AS (SELECT o_orderkey AS upload_id, 'src' || (o_orderkey % 20) AS knowledge_base_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS initiated_by_id, floor(o_totalprice * 100)::BIGINT AS total_bytes,
  CASE o_orderstatus WHEN 'F' THEN floor(o_totalprice * 100)::BIGINT WHEN 'O' THEN floor(o_totalprice * 50)::BIGINT ELSE 0 END AS received_bytes, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' ELSE 'open' END AS status,
  TIMESTAMP '{AS_OF}' + to_minutes(o_orderkey % 2000 - 100) AS expires_at, sha256((o_orderkey % 700)::VARCHAR) AS declared_sha256 FROM orders)"""


def all_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100)
    received = F.when(F.col("o_orderstatus") == "F", size).when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") * 50)).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        key.alias("upload_id"), F.concat(F.lit("src"), (key % 20).cast("string")).alias("knowledge_base_id"), F.when(key % 9 != 0, F.col("o_custkey")).alias("initiated_by_id"),
        size.cast("long").alias("total_bytes"), received.cast("long").alias("received_bytes"), F.when(key % 4 == 0, "completed").otherwise("open").alias("status"),
        F.timestamp_add("MINUTE", (key % 2000 - 100).cast("int"), F.lit(AS_OF).cast("timestamp")).alias("expires_at"), F.sha2((key % 700).cast("string").cast("binary"), 256).alias("declared_sha256"),
    )


@query(f"WITH {UPLOADS} SELECT upload_id, knowledge_base_id, c_name AS initiated_by, status, received_bytes FROM uploads LEFT JOIN customer ON c_custkey = initiated_by_id WHERE status <> 'completed'")
def upload_listing_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads under way, with the name of who began them where that is known."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("initiated_by_id"), F.col("c_name").alias("initiated_by"))
    rows = all_uploads(spark, sf_dir).filter("status <> 'completed'").join(names, "initiated_by_id", "left")
    return rows.select("upload_id", "knowledge_base_id", "initiated_by", "status", "received_bytes")


PART = DEFAULTS.upload_part_bytes


@query(f"""WITH {UPLOADS}, parts AS (SELECT upload_id, total_bytes, unnest(range(0, total_bytes, {PART})) AS offset_bytes FROM uploads WHERE total_bytes > 0) SELECT upload_id, offset_bytes, least({PART}, total_bytes - offset_bytes) AS length_bytes FROM parts""")
def upload_parts_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.plan_parts(all_uploads(spark, sf_dir))


@query("""WITH r AS (SELECT l_orderkey AS upload_id, sum(l_quantity::BIGINT) OVER w - l_quantity::BIGINT + CASE WHEN l_orderkey % 13 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END AS offset_bytes, l_quantity::BIGINT AS length_bytes FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, coalesce(sum(length_bytes) OVER (PARTITION BY upload_id ORDER BY offset_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM r)
SELECT upload_id, count(*) AS n_parts, count(*) FILTER (offset_bytes = expected) AS n_in_order, sum(length_bytes)::BIGINT AS received_bytes FROM e GROUP BY 1""")
def upload_offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as parts of uploads; some leave a gap."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("l_quantity").cast("long")
    gap = F.when((F.col("l_orderkey") % 13 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.sum(size).over(order) - size + gap).alias("offset_bytes"), size.alias("length_bytes"))
    rows = uploads.audit_offsets(parts).groupBy("upload_id")
    return rows.agg(F.count("*").alias("n_parts"), F.count_if("in_order").alias("n_in_order"), F.sum("length_bytes").alias("received_bytes"))


@query(f"WITH {UPLOADS} SELECT upload_id, CASE WHEN total_bytes > 0 THEN least(100, 100 * received_bytes // total_bytes) ELSE 0 END::INTEGER AS percent FROM uploads")
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_uploads(spark, sf_dir).select("upload_id", progress(F.col("received_bytes"), F.col("total_bytes")).alias("percent"))


@query(f"WITH {UPLOADS} SELECT upload_id, CASE WHEN total_bytes < 1048576 THEN greatest(1, floor(total_bytes / 1024 + 0.5))::BIGINT || ' KB' ELSE printf('%.1f MB', floor(total_bytes / 1048576 * 10 + 0.5) / 10) END AS size FROM uploads")
def byte_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_uploads(spark, sf_dir).select("upload_id", file_size(F.col("total_bytes")).alias("size"))


@query(f"WITH {UPLOADS} SELECT knowledge_base_id, count(*) AS n_expired, sum(total_bytes - received_bytes)::BIGINT AS missing_bytes, min(expires_at) AS first_expiry FROM uploads WHERE status = 'open' AND expires_at <= TIMESTAMP '{AS_OF}' GROUP BY 1")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_uploads(spark, sf_dir).filter((F.col("status") == "open") & (F.col("expires_at") <= F.lit(AS_OF).cast("timestamp")))
    found = rows.groupBy("knowledge_base_id").agg(F.count("*").alias("n_expired"), F.sum(F.col("total_bytes") - F.col("received_bytes")).alias("missing_bytes"), F.min("expires_at").alias("first_expiry"))
    return found.withColumn("first_expiry", F.col("first_expiry").cast("timestamp_ntz"))


@query(f"""WITH {UPLOADS}, docs AS (SELECT source AS kb, sha256((doc_id % 900)::VARCHAR) AS sha FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT upload_id, knowledge_base_id, CASE WHEN status = 'completed' THEN 'completed before' WHEN expires_at <= TIMESTAMP '{AS_OF}' THEN 'expired' WHEN received_bytes <> total_bytes THEN 'incomplete' WHEN upload_id % 17 = 0 THEN 'no file' WHEN upload_id % 19 = 0 THEN 'other content'
  WHEN n >= 10000 THEN 'capacity' WHEN EXISTS (SELECT 1 FROM docs WHERE kb = knowledge_base_id AND sha = declared_sha256) THEN 'duplicate document' ELSE 'completed' END AS outcome FROM uploads, n""")
def upload_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What completing each upload comes to."""
    rows = all_uploads(spark, sf_dir)
    other = F.when(F.col("upload_id") % 19 == 0, "other").otherwise(F.col("declared_sha256"))
    files = rows.filter("upload_id % 17 <> 0").select("upload_id", F.col("total_bytes").alias("size_bytes"), other.alias("sha256"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("knowledge_base_id"), F.sha2((F.col("doc_id") % 900).cast("string").cast("binary"), 256).alias("sha256"))
    return uploads.complete_sessions(rows, files, docs, AS_OF)


@query(f"""WITH {UPLOADS}, docs AS (SELECT DISTINCT source AS kb, sha256((doc_id % 300)::VARCHAR) AS sha FROM documents), o AS (SELECT knowledge_base_id AS kb, declared_sha256 AS sha, max(total_bytes) AS size FROM uploads WHERE status = 'open' AND upload_id % 997 = 1 GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM uploads WHERE status = 'open' AND upload_id % 997 = 1),
asked AS (SELECT page_id AS request_id, 'src' || (page_id % 20) AS kb, sha256((page_id % 700)::VARCHAR) AS sha, length(html) * 20000 AS size, CASE page_id % 6 WHEN 0 THEN 'a.html' WHEN 1 THEN 'b.PDF' ELSE 'c.txt' END AS name FROM pages),
early AS (SELECT a.*, CASE WHEN name = 'a.html' THEN 'format' WHEN a.size > 52428800 THEN 'too large' WHEN d.sha IS NOT NULL THEN 'duplicate document' WHEN o.size = a.size THEN 'resumed' WHEN o.size IS NOT NULL THEN 'other file' END AS e FROM asked a LEFT JOIN docs d ON d.kb = a.kb AND d.sha = a.sha LEFT JOIN o ON o.kb = a.kb AND o.sha = a.sha),
firsts AS (SELECT min(request_id) AS request_id FROM early WHERE e IS NULL GROUP BY kb, sha), placed AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS p FROM firsts)
SELECT request_id, kb AS knowledge_base_id, sha AS sha256, coalesce(e, CASE WHEN n + p <= 20 THEN 'created' ELSE 'capacity' END) AS outcome FROM early LEFT JOIN placed USING (request_id), n""")
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many requests get an upload session, and why the others don't; a few uploads are under way."""
    return admitted(spark, sf_dir, all_uploads(spark, sf_dir).filter("upload_id % 997 = 1"))


@query(ORACLES["upload_admission"].replace(" AND upload_id % 997 = 1", ""))
def upload_admission_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests against all uploads under way."""
    return admitted(spark, sf_dir, all_uploads(spark, sf_dir))


@query(ORACLES["upload_admission_full"].replace("status = 'open'", f"status = 'open' AND expires_at > TIMESTAMP '{AS_OF}'").replace(" FROM early LEFT JOIN placed", f", CASE WHEN outcome IN ('resumed', 'created') THEN TIMESTAMP '{AS_OF}' + INTERVAL 86400 SECOND END AS expires_at FROM early LEFT JOIN placed"))
def upload_admission_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the uploads whose time isn't over, and until when what is resumed or created lives."""
    found = admitted(spark, sf_dir, all_uploads(spark, sf_dir), AS_OF)
    return found.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


def admitted(spark: SparkSession, sf_dir: str, sessions: DataFrame, as_of: str | None = None) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    page = F.col("page_id")
    name = F.when(page % 6 == 0, "a.html").when(page % 6 == 1, "b.PDF").otherwise("c.txt")
    asked = table(spark, sf_dir, "pages").select(page.alias("request_id"), F.concat(F.lit("src"), (page % 20).cast("string")).alias("knowledge_base_id"), sha(page % 700).alias("sha256"), (F.char_length("html").cast("long") * 20000).alias("size_bytes"), name.alias("original_name"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("knowledge_base_id"), sha(F.col("doc_id") % 300).alias("sha256"))
    return uploads.admit(asked, docs, sessions, as_of) if as_of else uploads.create_sessions(asked, docs, sessions)


THROTTLE = Settings(login_window_seconds=3600, login_attempt_limit=5)


def throttle_key() -> Column:
    """Ten users to a key, so that runs occur and keys grow with the users."""
    return F.expr("user_id div 10").alias("key")


def failures(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """Error events as failed logins."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("""WITH f AS (SELECT user_id % 10 AS key, ts, lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS before, event_id FROM events WHERE event_type = 'error'),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 3600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM f)
SELECT key, min(ts) AS first_failure, max(ts) AS last_failure, count(*) AS failures, count(*) >= 5 AS blocked FROM g GROUP BY key, run""")
def login_throttle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of failures where all users share ten keys."""
    return throttled(spark, sf_dir, (F.col("user_id") % 10).alias("key"))


@query(ORACLES["login_throttle_sessions"].replace("user_id % 10", "user_id // 10"))
def login_throttle_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of failures with ten users to a key."""
    return throttled(spark, sf_dir, throttle_key())


def throttled(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    found = uploads.throttle_sessions(failures(spark, sf_dir, key), THROTTLE)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_failure", "last_failure")})


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2""")
def hourly_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each hourly run finds."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("n_users"))


NAMED = r"named AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C:\dir\' || url WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '.PDF' WHEN 2 THEN url || '/ ' ELSE '/x/' || page_id || chr(9) || '.md' END AS name FROM pages)"
SAFE = r"trim(regexp_replace(regexp_extract(replace(name, '\', '/'), '[^/]*$'), '[\p{C}]', '', 'g'))"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    name = F.when(page % 4 == 0, F.concat(F.lit("C:\\dir\\"), url)).when(page % 4 == 1, F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit(".PDF"))).when(page % 4 == 2, F.concat(url, F.lit("/ "))).otherwise(F.concat(F.lit("/x/"), page.cast("string"), F.lit("\t.md")))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(f"WITH {NAMED} SELECT page_id, left(CASE WHEN {SAFE} = '' THEN 'document' || coalesce(nullif(regexp_extract(lower(name), '[^./\\\\](\\.[^./\\\\]+)$', 1), ''), '') ELSE {SAFE} END, 255) AS safe_name FROM named")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir).select("page_id", safe_name(F.col("name")).alias("safe_name"))


@query(f"WITH {NAMED}, s AS (SELECT page_id, regexp_extract(lower(name), '[^./\\\\](\\.[^./\\\\]+)$', 1) AS suffix FROM named) SELECT page_id, suffix, CASE suffix WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown' END AS media_type FROM s")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = file_names(spark, sf_dir).select("page_id", suffix(F.col("name")).alias("suffix"))
    return named.select("page_id", "suffix", media_type(F.col("suffix")).alias("media_type"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a PDF' WHEN 2 THEN 'binary data' ELSE 'suffix' END AS format_error, CASE doc_id % 4 WHEN 0 THEN 'text/plain' END AS media_type, octet_length(encode(text)) + CASE doc_id % 4 WHEN 2 THEN 1 ELSE 0 END AS size_bytes FROM documents""")
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as uploaded files, some under a name that they aren't."""
    kind = F.col("doc_id") % 4
    content = F.when(kind == 2, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    files = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.when(kind == 1, ".pdf").when(kind == 3, ".html").otherwise(".txt").alias("suffix"))
    return sniff(files).select("doc_id", "format_error", "media_type", F.octet_length("content").cast("long").alias("size_bytes"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS section_no, length(trim(line))::INTEGER AS n_chars, (2 * i - 1)::INTEGER AS line_start FROM lines WHERE trim(line) <> ''""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line after each line: every line is a section."""
    spaced = F.regexp_replace(decoded(F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n\r\n")).cast("binary")), "\r", "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), spaced.alias("text"))
    return sections_of(docs).select("document_id", F.col("section_no").cast("int").alias("section_no"), F.char_length("text").alias("n_chars"), "line_start")


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
headed AS (SELECT doc_id, i, CASE WHEN length(line) BETWEEN 2 AND 40 AND trim(line) <> '' THEN '## ' || line ELSE line END AS line, CASE WHEN length(line) BETWEEN 2 AND 40 AND trim(line) <> '' THEN trim(line) END AS heading FROM lines),
grouped AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY i) AS g, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'Document') AS section FROM headed),
found AS (SELECT doc_id, g, section, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS text, min(i) AS line_start, max(i) AS line_end FROM grouped GROUP BY 1, 2, 3)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INTEGER AS section_no, section, md5(text) AS digest, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end FROM found WHERE text <> ''""")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose short lines are headings."""
    marked = lambda x: F.when(F.char_length(x).between(2, 40) & (F.trim(x) != ""), F.concat(F.lit("## "), x)).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), marked), "\n")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), text.alias("text"))
    return markdown_sections(docs).select("document_id", "section_no", "section", F.md5(F.col("text").cast("binary")).alias("digest"), "line_start", "line_end")


@query("""WITH d AS (SELECT d.doc_id AS document_id, CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'failed' WHEN d.doc_id % 3 = 0 THEN 'deleting' WHEN d.doc_id % 3 = 1 THEN 'pending' ELSE 'processing' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT document_id, status AS before, CASE WHEN status IN ('pending', 'failed') THEN 'processing' ELSE status END AS claimed, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS retried, status = 'deleting' AS purged FROM d""")
def document_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claiming, retrying and purging do to documents in each state."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.col("doc_id") % 3
    status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").when(kind == 0, "deleting").when(kind == 1, "pending").otherwise("processing")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("document_id"), status.alias("status"))
    rows = docs.select("document_id", F.col("status").alias("before"), lifecycle.claimed(F.col("status")).alias("claimed"), lifecycle.retried(F.col("status")).alias("retried"))
    gone = lifecycle.purge(docs).select("document_id", F.lit(False).alias("purged"))
    return rows.join(gone, "document_id", "left").withColumn("purged", F.coalesce("purged", F.lit(True)))


@query("""SELECT source AS knowledge_base_id, count(*) AS n_documents, count(*) FILTER (quality = 1) AS n_ready, bool_or(quality IS NULL) AS active, max(d.doc_id) AS newest, sum(octet_length(encode(text)))::BIGINT AS size_bytes FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge bases with how many documents they have, how many are ready, and whether any is under way."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy(F.col("source").alias("knowledge_base_id"))
    return rows.agg(F.count("*").alias("n_documents"), F.count_if(F.col("quality") == 1).alias("n_ready"), F.bool_or(F.col("quality").isNull()).alias("active"), F.max("doc_id").alias("newest"), F.sum(F.octet_length("text")).alias("size_bytes"))


@query("""WITH files AS (SELECT event_id, 'key' || (event_id % 5000) AS storage_key, ts AS modified_at FROM events) SELECT event_id, storage_key FROM files WHERE modified_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 300 SECOND AND storage_key NOT IN (SELECT 'key' || (o_orderkey % 3000) FROM orders)""")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no upload has, older than the grace period."""
    files = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key"), (F.col("event_id") % 5000).cast("string")).alias("storage_key"), F.col("ts").alias("modified_at"))
    sessions = table(spark, sf_dir, "orders").select(F.concat(F.lit("key"), (F.col("o_orderkey") % 3000).cast("string")).alias("temporary_storage_key"))
    return uploads.orphans(files, sessions, AS_OF).select("event_id", "storage_key")


@query("""SELECT doc_id AS document_id, 'page: ' || (n_chars % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' · section: ' || source ELSE '' END || ' · part: ' || (doc_id % 4 + 1) AS locator FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'Document excerpt' FROM documents WHERE doc_id % 5 = 0""")
def locator_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in documents as people read them."""
    key, some = F.col("doc_id"), F.col("doc_id") % 5 != 0
    locator = F.struct(F.when(some, F.col("n_chars") % 9 + 1).alias("page"), F.when(some & (key % 2 == 0), F.col("source")).alias("section"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.when(some, key % 4 + 1).alias("part"))
    return table(spark, sf_dir, "documents").select(key.alias("document_id"), lifecycle.locator_text(locator).alias("locator"))
