"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.language_id import identify, learn
from lodestone.llm.shared import is_training_row


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document with profiles learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = is_training_row(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), learn(docs, train))
    return found.select("doc_id", (~train).alias("held_out"), "lang_pred", "score")
