"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.alignment import align_documents


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every document, and how common its linked pairs are."""
    import public_tokenizers

    paths = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), *paths)
