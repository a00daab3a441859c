"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.url_filter import judge

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the URL of every page by the rules, or else by the regression."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
