"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import new_path
from lodestone.llm.token_files import read_token_files, write_token_files

END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as Arrow sequence files and reads every document back from them."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID
    )
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
