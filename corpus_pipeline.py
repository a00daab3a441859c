"""The corpus pipeline: documents in, sampled piece ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.jaccard_join import keep_one
from lodestone.llm.language_id import UNDETERMINED, identify, learn, nearness_limits
from lodestone.llm.mixing import mix
from lodestone.llm.op3_query import model_path
from lodestone.llm.piece_sampling import encode
from lodestone.llm.shared import is_training_row, written
from lodestone.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Nearness to the best profile below which a document is in none of the learned languages, whatever the training rows' scores.
MIN_NEARNESS = 0.1
#: Letters below which a text is too short for the limit of its language, so that only MIN_NEARNESS holds.
SHORT_LETTERS = 40


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter and those nearer to no profile than its language's
    training rows are go. So null, empty and blank texts go, and repeated rows go or stay together. Where no row has a
    language to learn, all go; an empty table stays empty."""
    train, text = is_training_row(F.col("doc_id")), F.xxhash64("text").alias("text_hash")
    short = F.char_length(F.regexp_replace("text", r"\P{L}", "")) < SHORT_LETTERS
    judged = identify(docs, learn(docs, train)).select("doc_id", text, "lang", "lang_pred", "score", short.alias("short"))
    found = written(judged, "judged")  # without the texts: stored tables stay, and would be a whole input more on disk
    limits, other = nearness_limits(found.filter(train), MIN_NEARNESS)
    limit = F.lit(other)
    if limits:
        limit = F.coalesce(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("lang_pred")], limit)
    near = (F.col("score") >= limit) | ((F.col("score") >= MIN_NEARNESS) & F.col("short"))
    stays = F.coalesce((F.col("lang_pred") != UNDETERMINED) & near, F.lit(False))
    # A table of its own, so that Spark knows its size: the texts are not shuffled where few go.
    gone = written(found.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "rejected")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the one with the least doc_id (a null one last). Rows without a word
    stay; repeated rows are copies of each other; an empty table stays empty."""
    return keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once; texts that lose nothing stay as they are, null and
    empty ones among them. n_chars is counted anew where a text changes (null for a null text)."""
    cut = remove_repeats(docs.drop("n_chars"))  # a column that nothing reads would cost a second shuffle of the texts
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in the order of the mix. Documents without a word have no size
    and are taken with their block; a null source is one of its own; rows with one doc_id and source go together."""
    return mix(docs).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document; none for a null text, that of the blank before it for an empty one. Equal texts with
    equal ids, so the repeats of the mix too, are cut alike."""
    return encode(docs.select("doc_id", "text"), model_path()).select("doc_id", "n_pieces", "ids")


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", join_stage),
    ("substring_dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("piece_sampling", pieces_stage),
]

#: SQL expresses none of these stages' methods; the tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
