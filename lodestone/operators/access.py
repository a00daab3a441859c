"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that the product of administrators and knowledge bases is dealt out to.
PLACES = 64


def accessible(users: DataFrame, knowledge_bases: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, knowledge_base_id) that each enabled user may see: all for administrators, else what is granted.

    What administrators see is a product of two tables, dealt out evenly: each knowledge base has one of PLACES, and each
    administrator goes to all of them, so that no task has more than its part of the result.
    """
    on = users.filter("is_enabled")
    granted = grants.select("user_id", "knowledge_base_id").distinct()
    plain = granted.join(on.filter("NOT is_administrator").select("user_id"), "user_id", "left_semi").join(knowledge_bases.select("knowledge_base_id"), "knowledge_base_id", "left_semi")
    place = F.pmod(F.xxhash64("knowledge_base_id"), F.lit(PLACES)).cast("int")
    every = knowledge_bases.select("knowledge_base_id", place.alias("_place"))
    admins = on.filter("is_administrator").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("_place"))
    return plain.select("user_id", "knowledge_base_id").unionByName(admins.join(every, "_place").select("user_id", "knowledge_base_id"))


def visible(rows: DataFrame, grants: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """rows (owner_id, knowledge_base_id) whose owner is still granted their knowledge base; with users, also those of
    enabled administrators, who need no grant."""
    granted = rows.join(grants, (rows.owner_id == grants.user_id) & (rows.knowledge_base_id == grants.knowledge_base_id), "left_semi")
    if users is None:
        return granted
    admins = _administrators(users)
    return rows.join(admins, "owner_id", "left_semi").unionByName(granted.join(admins, "owner_id", "left_anti")).select(*rows.columns)


def revoked(rows: DataFrame, grants: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The rows that visible() leaves out."""
    lost = rows.join(grants, (rows.owner_id == grants.user_id) & (rows.knowledge_base_id == grants.knowledge_base_id), "left_anti")
    return lost if users is None else lost.join(_administrators(users), "owner_id", "left_anti").select(*rows.columns)


def _administrators(users: DataFrame) -> DataFrame:
    return users.filter("is_administrator AND is_enabled").select(F.col("user_id").alias("owner_id"))


def bootstrap(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of wanted (user_id, username) that become the first administrator: one, and none where there is one already
    or its name is taken."""
    there = users.filter("is_administrator").limit(1).select(F.lit(True).alias("_there"))
    first = wanted.orderBy("user_id").limit(1).join(F.broadcast(there), how="left").filter("_there IS NULL").drop("_there")  # a row at most
    names = users.select(F.lower("username").alias("_name"))
    return first.join(names, F.lower(first.username) == names["_name"], "left_anti")


def update_knowledge_bases(knowledge_bases: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """knowledge_bases (knowledge_base_id, name, description, updated_at) after changes (knowledge_base_id, name,
    description; null: as it is), with outcome: changed, same, or name taken, in which case nothing changes. Of several
    that want one name, the least id gets it, and only if nobody has it now."""
    new = changes.select("knowledge_base_id", F.trim("name").alias("_name"), F.col("description").alias("_description"))
    renamed = F.col("_name").isNotNull() & (F.col("_name") != F.col("name"))
    # Names are judged among the rows that change theirs alone; all others would meet under no name.
    asked = new.join(knowledge_bases.select("knowledge_base_id", "name"), "knowledge_base_id").filter(renamed).select("knowledge_base_id", "_name")
    held = knowledge_bases.select(F.col("name").alias("_name")).distinct().withColumn("_held", F.lit(True))
    first = asked.groupBy("_name").agg(F.min("knowledge_base_id").alias("_first"))
    judged = asked.join(first, "_name").join(held, "_name", "left")
    lost = judged.filter(F.col("_held").isNotNull() | (F.col("_first") != F.col("knowledge_base_id"))).select("knowledge_base_id", F.lit(True).alias("_lost"))
    rows = knowledge_bases.join(new, "knowledge_base_id", "left").join(lost, "knowledge_base_id", "left")
    taken = F.col("_lost").isNotNull()
    differs = renamed | (F.col("_description").isNotNull() & ~F.col("_description").eqNullSafe(F.col("description")))
    outcome = F.when(taken, "name taken").when(differs, "changed").otherwise("same")
    pick = lambda new, old: F.when(F.col("outcome") == "changed", F.coalesce(new, old)).otherwise(F.col(old)).alias(old)
    now = F.when(F.col("outcome") == "changed", F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at")
    return rows.withColumn("outcome", outcome).select("knowledge_base_id", pick("_name", "name"), pick("_description", "description"), now, "outcome")


def without_grants(grants: DataFrame, removed: DataFrame) -> DataFrame:
    """grants without those of removed (user_id, knowledge_base_id); removing what isn't there changes nothing."""
    return grants.join(removed, ["user_id", "knowledge_base_id"], "left_anti")


def deletable(knowledge_bases: DataFrame, documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """Knowledge bases without documents and without uploads that aren't completed."""
    live = uploads.filter("status <> 'completed'")
    return knowledge_bases.join(documents, "knowledge_base_id", "left_anti").join(live, "knowledge_base_id", "left_anti")


def change_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users after changes (user_id, is_enabled, is_administrator; null: as it is), with outcome.

    Whoever is disabled or changes role gets a new session version. Changes that would leave no enabled administrator
    are refused, all of them.
    """
    rows = users.join(changes.select("user_id", F.col("is_enabled").alias("_on"), F.col("is_administrator").alias("_admin")), "user_id", "left")
    rows = rows.withColumn("_on", F.coalesce("_on", "is_enabled")).withColumn("_admin", F.coalesce("_admin", "is_administrator"))
    left = rows.agg(F.count_if(F.col("_on") & F.col("_admin")).alias("_left"))
    rows = rows.join(F.broadcast(left))  # one row
    loses = F.col("is_enabled") & F.col("is_administrator") & ~(F.col("_on") & F.col("_admin"))
    refused = loses & (F.col("_left") == 0)
    differs = (F.col("_on") != F.col("is_enabled")) | (F.col("_admin") != F.col("is_administrator"))
    bump = ~refused & ((F.col("is_enabled") & ~F.col("_on")) | (F.col("_admin") != F.col("is_administrator")))
    return rows.select(
        "user_id", F.when(refused, F.col("is_enabled")).otherwise(F.col("_on")).alias("is_enabled"),
        F.when(refused, F.col("is_administrator")).otherwise(F.col("_admin")).alias("is_administrator"),
        (F.col("session_version") + bump.cast("int")).alias("session_version"),
        F.when(refused, "last administrator").when(differs, "changed").otherwise("same").alias("outcome"),
    )


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: str, max_age_seconds: int) -> DataFrame:
    """sessions (user_id, version, issued_at) with valid: the user is there and enabled, the version is theirs, and the
    session is not too old."""
    rows = sessions.join(users.select("user_id", "is_enabled", "session_version"), "user_id", "left")
    young = F.col("issued_at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return rows.withColumn("valid", F.coalesce(F.col("is_enabled") & (F.col("version") == F.col("session_version")) & young, F.lit(False)))


def insert_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Those of rows whose key isn't there yet; of several with one key, one. Inserting again does nothing."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def violations(rows: DataFrame, key: list[str], where: str | None = None) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return (rows.filter(where) if where else rows).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
