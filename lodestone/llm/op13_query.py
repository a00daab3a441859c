"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.conversation_repair import audit

#: What a conversation of which no turn is left gets.
NOTHING = {"audit": "", "repaired_sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with damage that a hash of conversation and number chooses. Null values are one space, but null ids and
    numbers stay null."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    chosen = turns.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind")).filter("kind <> 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return chosen.select("conv_id", "turn", role.alias("role"), new_text.alias("text"), F.explode(times).alias("time")).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least repair of every conversation after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    found = audit(damaged(turns))
    both = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    rest = [F.coalesce(c, F.lit(NOTHING.get(c, 0))).alias(c) for c in found.columns if c != "conv_id"]
    return both.select(F.col("every").alias("conv_id"), *rest)
