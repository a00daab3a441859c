"""Embedding responses: what a provider sends back for a batch of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.vectors import is_finite

RESPONSE = "struct<output: struct<embeddings: array<struct<index: int, embedding: array<double>>>>>"


def read_responses(responses: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(request_id, error) of responses (request_id, n_texts, body), and the vectors (request_id, position, embedding) of
    those without an error, in the order of their indexes.

    There must be one vector for each text, their indexes 0 and up, each of the model's dimension, with finite parts.
    """
    items = F.from_json("body", RESPONSE)["output"]["embeddings"]
    rows = responses.select("request_id", "n_texts", F.array_sort(items, lambda a, b: F.coalesce(a["index"] - b["index"], F.lit(0))).alias("_items"))
    indexes = F.transform("_items", lambda x: x["index"])
    wanted = F.when(F.col("n_texts") > 0, F.sequence(F.lit(0), F.col("n_texts").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    error = (
        F.when(F.col("_items").isNull(), "format")
        .when(F.size("_items") != F.col("n_texts"), "count")
        .when(~F.coalesce(indexes == wanted, F.lit(False)), "index")
        .when(F.exists("_items", lambda x: ~F.coalesce(F.size(x["embedding"]) == settings.embedding_dimension, F.lit(False))), "dimension")
        .when(F.exists("_items", lambda x: ~F.coalesce(is_finite(x["embedding"]), F.lit(False))), "not finite")
    )
    judged = rows.withColumn("error", error)
    vectors = judged.filter("error IS NULL").select("request_id", F.posexplode(F.transform("_items", lambda x: x["embedding"])).alias("position", "embedding"))
    return judged.select("request_id", "error"), vectors
