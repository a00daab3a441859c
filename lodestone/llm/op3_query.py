"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.piece_sampling import decode, encode


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document by a sampled segmentation and decodes it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs, model_path()), model_path())
    return back.select(
        "doc_id", "n_pieces", F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
