"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.jaccard_join import join_similar


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of similar texts that every document is in, and its number of links."""
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
