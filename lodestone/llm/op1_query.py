"""Query of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.substring_dedup import remove_repeats


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when all repeated windows of 35 words go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
