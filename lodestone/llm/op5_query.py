"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.quality_knn import judge, learn
from lodestone.llm.shared import is_training_row


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by voters among the labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    train = is_training_row(F.col("doc_id"))
    found = judge(docs, learn(docs, labels.filter(train)))
    return found.select("doc_id", (~train).alias("held_out"), "score", "predicted")
