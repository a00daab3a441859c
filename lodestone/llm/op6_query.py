"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.fingerprints import fingerprint


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
