"""What people see of tables: public columns, in their order, each row with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import new_path

#: The columns of each table that may be shown.
PUBLIC = {
    "users": ("user_id", "username", "is_administrator", "is_enabled", "created_at"),
    "knowledge_bases": ("knowledge_base_id", "name", "description", "created_at"),
    "documents": ("document_id", "knowledge_base_id", "original_name", "media_type", "size_bytes", "page_count", "status", "safe_error", "created_at", "updated_at"),
    "uploads": ("upload_id", "knowledge_base_id", "initiated_by_id", "initiated_by_username", "original_name", "declared_sha256", "total_bytes", "received_bytes", "part_size_bytes", "status", "safe_error", "resulting_document_id", "expires_at", "created_at", "updated_at"),
    "conversations": ("conversation_id", "knowledge_base_id", "knowledge_base_name", "title", "created_at", "updated_at"),
    "messages": ("message_id", "sequence", "role", "status", "content", "created_at"),
    "citations": ("citation_id", "document_name", "locator", "excerpt", "retrieval_rank", "retrieval_score", "source_available", "source_url"),
}


def public(rows: DataFrame, table: str, *also: str) -> DataFrame:
    """The columns of a table that may be shown, and `also` (keys and places that the caller lists by)."""
    return rows.select(*dict.fromkeys((*also, *PUBLIC[table])))


def placed(rows: DataFrame, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """rows with place, from 1 in the order given, or in each group of the columns `within`. The order must have no ties.

    All rows are sorted over all tasks, by group first, and each task numbers what it has; what comes before it is added
    afterwards, and so is where each group begins. So no group, and no table without groups, is ever in one task.
    """
    keys = within or []
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "listing")
    number = F.monotonically_increasing_id()  # the task in the upper bits, the row in the lower 33
    ordered = rows.orderBy(*keys, *order).withColumn("place", number)
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path)
    task, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()  # a row a task
    before, total = {}, 0
    for found in sorted(sizes, key=lambda r: r.task):
        before[found.task], total = total, total + found.n
    starts = spark.createDataFrame(list(before.items()), "task long, before long")
    numbered = stored.withColumns({"task": task, "place": row + 1}).join(F.broadcast(starts), "task")
    numbered = numbered.withColumn("place", F.col("place") + F.col("before")).drop("task", "before")
    if not keys:
        return numbered
    firsts = numbered.groupBy(*(F.col(k).alias(f"group_{i}") for i, k in enumerate(keys))).agg((F.min("place") - 1).alias("group_before"))
    same = [F.col(k).eqNullSafe(F.col(f"group_{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(firsts, same, "left").withColumn("place", F.col("place") - F.col("group_before"))
    return joined.drop("group_before", *(f"group_{i}" for i in range(len(keys))))


def list_users(users: DataFrame) -> DataFrame:
    return public(placed(users, [F.col("username"), F.col("user_id")]), "users", "place")


def list_knowledge_bases(knowledge_bases: DataFrame) -> DataFrame:
    """All of them by name, as administrators see them."""
    return public(placed(knowledge_bases, [F.col("name"), F.col("knowledge_base_id")]), "knowledge_bases", "place")


def list_accessible(accessible: DataFrame, knowledge_bases: DataFrame) -> DataFrame:
    """Those that each user of accessible (user_id, knowledge_base_id) may see, by name."""
    rows = accessible.join(knowledge_bases, "knowledge_base_id")
    return public(placed(rows, [F.col("name"), F.col("knowledge_base_id")], ["user_id"]), "knowledge_bases", "user_id", "place")


def list_documents(documents: DataFrame) -> DataFrame:
    """The documents of each knowledge base, latest first."""
    return public(placed(documents, [F.desc("created_at"), F.col("document_id")], ["knowledge_base_id"]), "documents", "place")


def list_uploads(uploads: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """The uploads of each knowledge base that are not completed and whose time isn't over, latest first, with the name of
    who began them where that is known."""
    live = uploads.filter((F.coalesce("status", F.lit("open")) != "completed") & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    names = users.select(F.col("user_id").alias("initiated_by_id"), F.col("username").alias("initiated_by_username"))
    rows = live.join(names, "initiated_by_id", "left")
    return public(placed(rows, [F.desc("created_at"), F.col("upload_id")], ["knowledge_base_id"]), "uploads", "place")


def list_messages(messages: DataFrame) -> DataFrame:
    """The messages of each conversation in their sequence."""
    return public(placed(messages, [F.col("sequence"), F.col("message_id")], ["conversation_id"]), "messages", "conversation_id", "place")


def list_citations(citations: DataFrame) -> DataFrame:
    """The citations of each message by the rank that they were retrieved at."""
    return public(placed(citations, [F.col("retrieval_rank"), F.col("citation_id")], ["message_id"]), "citations", "message_id", "place")
