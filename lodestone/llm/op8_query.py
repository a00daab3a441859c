"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.quality_rules import judge


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )
