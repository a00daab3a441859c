"""Queries that change rows, judge what people enter, and list what they see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.functions import checks
from lodestone.functions.ids import row_id
from lodestone.operators import access, lifecycle, uploads
from lodestone.plans.catalog import ORACLES, query, table
from lodestone.plans.conversation_queries import CITATIONS, citations, messages
from lodestone.plans.relational_queries import AS_OF, OWNED, UPLOADS, USERS, all_uploads, grants, knowledge_bases, owned, users
from lodestone.session import new_path
from lodestone.streaming import events, processors


@query(f"WITH {USERS}, {OWNED} SELECT conversation_id, owner_id FROM owned o WHERE EXISTS (SELECT 1 FROM users u WHERE u.user_id = o.owner_id AND is_administrator AND is_enabled) OR EXISTS (SELECT 1 FROM grants g WHERE g.user_id = o.owner_id AND g.knowledge_base_id = o.knowledge_base_id)")
def access_with_administrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose owners may see their knowledge base, by a grant or as administrators."""
    return access.visible(owned(spark, sf_dir), grants(spark, sf_dir), users(spark, sf_dir)).select("conversation_id", "owner_id")


@query(f"WITH {USERS}, {OWNED} SELECT conversation_id, owner_id FROM owned o WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = o.owner_id AND is_administrator AND is_enabled) AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.user_id = o.owner_id AND g.knowledge_base_id = o.knowledge_base_id)")
def revoked_but_for_administrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.revoked(owned(spark, sf_dir), grants(spark, sf_dir), users(spark, sf_dir)).select("conversation_id", "owner_id")


@query(f"""WITH {USERS}, {OWNED} SELECT o.owner_id, row_number() OVER (PARTITION BY o.owner_id ORDER BY updated_at DESC, conversation_id)::INTEGER AS place, conversation_id, o.knowledge_base_id AS knowledge_base, updated_at
FROM owned o JOIN kbs k ON k.knowledge_base_id = o.knowledge_base_id""")
def conversation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's conversations with the name of their knowledge base, latest first; only what may be shown."""
    named = owned(spark, sf_dir).join(knowledge_bases(spark, sf_dir), "knowledge_base_id")
    order = Window.partitionBy("owner_id").orderBy(F.desc("updated_at"), "conversation_id")
    return named.select("owner_id", F.row_number().over(order).alias("place"), "conversation_id", F.col("knowledge_base_id").alias("knowledge_base"), "updated_at")


KBS = "kbs AS (SELECT DISTINCT source AS knowledge_base_id FROM documents WHERE source IS NOT NULL)"


@query(f"""WITH {KBS} SELECT knowledge_base_id, CASE WHEN knowledge_base_id IN ('src5') THEN 'fresh' ELSE knowledge_base_id END AS name, CASE WHEN knowledge_base_id = 'src7' THEN 'told' ELSE 'as it was' END AS description,
  CASE WHEN knowledge_base_id IN ('src5', 'src7') THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2023-01-01 00:00:00' END AS updated_at, CASE WHEN knowledge_base_id IN ('src5', 'src7') THEN 'changed' WHEN knowledge_base_id IN ('src3', 'src6') THEN 'name taken' ELSE 'same' END AS outcome FROM kbs""")
def knowledge_base_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamings, one to a name that is in use and two to one name, and a new description."""
    key = F.col("knowledge_base_id")
    now = knowledge_bases(spark, sf_dir).filter(key.isNotNull()).select("knowledge_base_id", key.alias("name"), F.lit("as it was").alias("description"), F.lit("2023-01-01").cast("timestamp").alias("updated_at"))
    wanted = F.when(key == "src3", "src4").when(key.isin("src5", "src6"), " fresh ").when(key == "src8", key)
    changes = now.select("knowledge_base_id", wanted.alias("name"), F.when(key == "src7", "told").alias("description"))
    found = access.update_knowledge_bases(now, changes, AS_OF)
    return found.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query(f"WITH {USERS} SELECT user_id, knowledge_base_id FROM grants WHERE NOT (user_id % 5 = 0 AND knowledge_base_id <> 'src0')")
def grant_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when users lose their grants, some of which they never had."""
    rows = grants(spark, sf_dir)
    removed = rows.filter((F.col("user_id") % 5 == 0) & (F.col("knowledge_base_id") != "src0")).unionByName(rows.limit(1).select((-F.col("user_id") - 1).alias("user_id"), "knowledge_base_id"))
    return access.without_grants(rows, removed)


@query(f"WITH {USERS} SELECT user_id, knowledge_base_id FROM grants WHERE user_id % 2 = 1")
def grant_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which grants are new when all are given twice over and those of every second user are there."""
    rows = grants(spark, sf_dir)
    return access.insert_new(rows.unionByName(rows), rows.filter("user_id % 2 = 0"), ["user_id", "knowledge_base_id"])


@query("SELECT lower(c_mktsegment) AS name, c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2 HAVING count(*) > 1")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several have, whatever their case, where that must not be."""
    rows = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    return access.violations(rows, ["name", "nation"], "c_acctbal > 0")


@query("""SELECT 'none yet' AS installation, min(c_custkey) AS user_id FROM customer WHERE c_custkey % 2 = 0""")
def bootstrap_administrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who becomes the first administrator of an installation that has none, and of one that has."""
    rows = users(spark, sf_dir)
    old, wanted = rows.filter("user_id % 2 = 1"), rows.filter("user_id % 2 = 0").select("user_id", "username")
    some = old.withColumn("is_administrator", F.lit(False))
    made = lambda there, name: access.bootstrap(there, wanted).select(F.lit(name).alias("installation"), "user_id")
    return made(some, "none yet").unionByName(made(old.withColumn("is_administrator", F.lit(True)), "one there"))


@query(f"""WITH {CITATIONS}, kept AS (SELECT * FROM messages WHERE conversation_id % 3 <> 0) SELECT k.conversation_id, count(DISTINCT k.id) AS n_messages, count(c.citation_id) AS n_citations FROM kept k LEFT JOIN citations c ON c.message_id = k.id GROUP BY 1""")
def conversation_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of messages and citations when every third conversation goes."""
    rows = messages(spark, sf_dir)
    deleted = rows.filter(F.col("conversation_id") % 3 == 0).select("conversation_id").distinct()
    kept, cited = lifecycle.cascade(rows, deleted, "conversation_id"), lifecycle.cascade(citations(spark, sf_dir), deleted, "conversation_id")
    n = cited.groupBy("conversation_id").agg(F.count("*").alias("n_citations"))
    found = kept.groupBy("conversation_id").agg(F.count("*").alias("n_messages")).join(n, "conversation_id", "left")
    return found.select("conversation_id", "n_messages", F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


@query("""WITH d AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR || chr(1) || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END::VARCHAR, chr(2))) AS m FROM orders)
SELECT o_orderkey AS order_key, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS id FROM d""")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of what rows hold, nulls among it."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("order_key"), row_id(key, F.when(key % 2 == 0, F.col("o_custkey"))).alias("id"))


@query(r"""WITH p AS (SELECT page_id, page_id % 6 AS kind, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, kind IN (0, 2, 3, 4) AS username, kind <> 1 AS password, kind <> 5 AS name, kind NOT IN (1, 4) AS inside, kind IN (0, 3) AS sha256,
  CASE kind WHEN 0 THEN 'https://' || host || '/v1' WHEN 1 THEN NULL WHEN 2 THEN 'http://localhost:8080' WHEN 3 THEN 'http://[::1]:11434/v1' WHEN 4 THEN NULL ELSE 'https://user:pw@' || host END AS provider FROM p""")
def field_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the values that people enter may be stored."""
    kind, host, page = F.pmod("page_id", F.lit(6)), F.regexp_extract("url", "://([^/?#]*)", 1), F.col("page_id").cast("string")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in v)), (kind + 1).cast("int"))
    plain = F.concat(F.lit("user."), page)
    digest = F.sha2(page.cast("binary"), 256)
    return table(spark, sf_dir, "pages").select(
        "page_id", checks.is_username(pick(plain, "ab", F.concat(F.lit("A_"), page, F.lit("x")), "a-b", F.rpad(plain, 64, "z"), "no blanks")).alias("username"),
        checks.is_password(pick("twelve chars", "too short", F.lpad(page, 128, "x"), "  white space  ", "päßwörter sind", F.lpad(page, 40, "y"))).alias("password"),
        checks.is_name(pick("A", " b ", F.lpad(page, 120, "n"), "c d", "  e", "   ")).alias("name"),
        checks.is_inside(pick("a/b.txt", "../a", "a/../b", "./a", "/etc/a", "a/b/../../c")).alias("inside"),
        checks.is_sha256(pick(digest, F.upper(digest), F.left(digest, F.lit(63)), digest, F.concat(digest, F.lit("\n")), F.lit(None).cast("string"))).alias("sha256"),
        checks.provider_url(pick(F.concat(F.lit("https://"), host, F.lit("/v1/")), F.concat(F.lit("http://"), host, F.lit("/")), "http://localhost:8080//", "http://[::1]:11434/v1", "ftp://localhost/", F.concat(F.lit("https://user:pw@"), host))).alias("provider"),
    )


@query("""WITH u AS (SELECT l_orderkey AS upload_id, count(*) AS n, count(*) * 10 - 3 AS total, l_orderkey % 8 AS kind, CASE l_orderkey % 8 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 99 END AS f FROM lineitem GROUP BY 1),
p AS (SELECT *, unnest(generate_series(1, n)) AS k FROM u)
SELECT upload_id, k AS sent, CASE WHEN kind = 6 THEN CASE WHEN k = 1 THEN 'confirmed again' ELSE 'stored' END WHEN kind = 7 THEN 'expired' WHEN k < f THEN 'stored' WHEN k > f THEN 'wrong offset' ELSE ['confirmed again', 'other bytes', 'wrong length', 'checksum mismatch', 'invalid checksum'][kind] END AS outcome,
  CASE WHEN kind = 6 THEN least(k * 10, total) WHEN kind = 7 THEN 0 WHEN k < f THEN least(k * 10, total) ELSE least((f - 1) * 10, total) END::BIGINT AS next_offset, kind NOT IN (5, 7) AS renewed FROM p""")
def put_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as parts of ten bytes of their orders; some are sent again, changed, cut short, or to an upload whose
    time is over."""
    return renewals(uploads.put_parts(*sent_parts(spark, sf_dir), AS_OF))


@query(ORACLES["put_parts"])
def stream_put_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts as a stream, in files of no order: uploads are opened, what was confirmed before is sent, then all."""
    sessions, receipts, parts = sent_parts(spark, sf_dir)
    now = F.lit(AS_OF).cast("timestamp")
    opened = sessions.select("upload_id", F.lit(-2).cast("long").alias("sent"), F.lit("open").alias("kind"), "total_bytes", F.col("part_bytes").cast("long").alias("part_bytes"), "expires_at")
    before = receipts.select("upload_id", F.lit(-1).cast("long").alias("sent"), F.lit("part").alias("kind"), "offset_bytes", "length_bytes", "sha256", F.col("length_bytes").alias("content_bytes"), F.col("sha256").alias("content_sha256"))
    ended = sessions.select("upload_id", F.lit(1 << 30).cast("long").alias("sent"), F.lit("complete").alias("kind"))
    rows = opened.unionByName(before, True).unionByName(ended, True).unionByName(parts.withColumn("kind", F.lit("part")), True).withColumn("ts", now)
    typed = rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in PART_TYPES.items()))
    path = new_path(spark, "part-files")
    typed.write.option("compression", "zstd").parquet(path)  # most of it are digests, which snappy leaves at their length
    with processors.state_on_disk(spark):
        found = events.run_available(processors.put_parts_stream(spark.readStream.schema(typed.schema).parquet(path)), "put-parts")
    return renewals(found.filter(f"sent BETWEEN 1 AND {(1 << 30) - 1}"))


PART_TYPES = {"upload_id": "long", "ts": "timestamp", "sent": "long", "kind": "string", "total_bytes": "long", "part_bytes": "long", "expires_at": "timestamp", "offset_bytes": "long", "length_bytes": "long", "sha256": "string", "content_bytes": "long", "content_sha256": "string"}


def sent_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, receipts and parts of put_parts()."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("k"))
    kind = F.col("upload_id") % 8
    at = F.least((F.col("k") - 1) * 10, F.col("total_bytes"))
    digest = lambda *parts: F.sha2(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"), 256)
    totals = lines.groupBy("upload_id").agg((F.count("*") * 10 - 3).alias("total_bytes"))
    sessions = totals.select("upload_id", "total_bytes", F.lit(10).alias("part_bytes"), F.when(kind == 6, F.least(F.lit(10), F.col("total_bytes"))).otherwise(0).alias("received_bytes"), F.lit("open").alias("status"), F.timestamp_add("MINUTE", F.when(kind == 7, 0).otherwise(5), F.lit(AS_OF).cast("timestamp")).alias("expires_at"))
    first = F.least(F.lit(10), F.col("total_bytes"))
    receipts = totals.filter(kind == 6).select("upload_id", F.lit(0).alias("offset_bytes"), first.alias("length_bytes"), digest(F.col("upload_id"), F.lit(0)).alias("sha256"))
    again, other, short, broken, bad = ((kind == n) & (F.col("k") == k) for n, k in ((1, 2), (2, 2), (3, 3), (4, 2), (5, 1)))
    rows = lines.join(totals, "upload_id").withColumn("offset_bytes", F.when(again | other, 0).otherwise(at))
    length = F.least(F.lit(10), F.col("total_bytes") - F.col("offset_bytes")) - F.when(short, 1).otherwise(0)
    own = digest(F.col("upload_id"), F.col("offset_bytes"))
    stated = F.when(bad, "no digest").when(other, digest(F.lit("other"))).otherwise(own)
    parts = rows.select("upload_id", F.col("k").alias("sent"), "offset_bytes", length.alias("length_bytes"), stated.alias("sha256"), length.alias("content_bytes"), F.when(broken, digest(F.lit("broken"))).otherwise(own).alias("content_sha256"))
    return sessions, receipts, parts


def renewals(found: DataFrame) -> DataFrame:
    renewed = F.col("expires_at") == F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(secs=F.lit(DEFAULTS.upload_session_ttl_seconds))
    return found.select("upload_id", "sent", "outcome", "next_offset", renewed.alias("renewed"))


@query(f"""WITH {UPLOADS} SELECT upload_id, CASE WHEN upload_id % 5 = 0 AND status <> 'completed' THEN 'cancelled' WHEN upload_id % 5 = 0 AND expires_at > TIMESTAMP '{AS_OF}' THEN 'refused' WHEN expires_at <= TIMESTAMP '{AS_OF}' THEN 'expired' ELSE 'kept' END AS fate FROM uploads""")
def upload_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of uploads that are cancelled, and of those whose time is over."""
    rows = all_uploads(spark, sf_dir)
    return uploads.end_sessions(rows, rows.filter("upload_id % 5 = 0").select("upload_id"), AS_OF).select("upload_id", "fate")


@query(f"""WITH {UPLOADS}, gone AS (SELECT upload_id, status FROM uploads WHERE expires_at <= TIMESTAMP '{AS_OF}')
SELECT upload_id, 'tmp' || upload_id AS storage_key FROM gone UNION ALL SELECT upload_id, 'file' || upload_id FROM gone WHERE status <> 'completed'
UNION ALL SELECT count(*), 'sessions that stay' FROM uploads WHERE expires_at > TIMESTAMP '{AS_OF}'""")
def upload_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an hourly run removes, and how many sessions it leaves."""
    key = F.col("upload_id").cast("string")
    rows = all_uploads(spark, sf_dir).select("*", F.concat(F.lit("tmp"), key).alias("temporary_storage_key"), F.concat(F.lit("file"), key).alias("final_storage_key"))
    stay, files = uploads.clean_up(rows, AS_OF)
    return files.unionByName(stay.agg(F.count("*").alias("upload_id")).select("upload_id", F.lit("sessions that stay").alias("storage_key")))
