"""States of documents, and publishing what was made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import snapshots

STATES = ("pending", "processing", "ready", "failed", "deleting")


def claimed(status: Column) -> Column:
    """Pending and failed documents are taken up; others stay."""
    return F.when(status.isin("pending", "failed"), "processing").otherwise(status)


def retried(status: Column) -> Column:
    return F.when(status == "failed", "pending").otherwise(status)


def published(status: Column, error: Column) -> Column:
    """Only what is still being processed becomes ready, or failed with an error."""
    return F.when(status == "processing", F.when(error.isNull(), "ready").otherwise("failed")).otherwise(status)


def purge(documents: DataFrame) -> DataFrame:
    """What is left when documents that are being deleted go."""
    return documents.filter(F.col("status") != "deleting")


def cascade(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """rows without those that belong to what was deleted."""
    return rows.join(deleted.select(key), key, "left_anti")


def publish_chunks(chunks: DataFrame, documents: DataFrame, path: str, most: int = snapshots.MOST_DELTAS) -> DataFrame:
    """Publishes the chunks (document_id, ordinal, ...) of documents (document_id, status) in place of what these documents
    have at `path`, and returns all that is then there. Other documents keep theirs. A document that isn't ready, or has
    no chunks, has none afterwards. What is written is the batch itself, as a delta; above `most` of them the table is
    compacted."""
    version = snapshots.publish(chunks, documents, path)
    spark = chunks.sparkSession
    if len(snapshots.manifest(spark, path, version).deltas) > most:
        version = snapshots.compact(spark, path)
    return snapshots.snapshot(spark, path, version)


def published_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks that publish_chunks() has put at a path."""
    return snapshots.snapshot(spark, path)


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (document_id, ordinal, ...) of the documents whose chunks have one vector each (document_id, ordinal,
    embedding), with embedding; and (document_id, error) of the others, where one lacks or there is one too many."""
    both = chunks.select("document_id", "ordinal", F.lit(True).alias("_chunk")).join(vectors.select("document_id", "ordinal", F.lit(True).alias("_vector")), ["document_id", "ordinal"], "full_outer")
    odd = both.groupBy("document_id").agg(F.count_if(F.col("_chunk").isNull() | F.col("_vector").isNull()).alias("_odd"), F.count("*").alias("_n"), F.countDistinct("ordinal").alias("_places"))
    errors = odd.filter((F.col("_odd") > 0) | (F.col("_n") > F.col("_places"))).select("document_id", F.lit("The number of vectors is not that of the chunks").alias("error"))
    return chunks.join(vectors, ["document_id", "ordinal"]).join(errors, "document_id", "left_anti"), errors


def locator_text(locator: Column) -> Column:
    """The parts of a place in a document that are known, or a general name."""
    parts = [F.when(locator[k].isNotNull(), F.concat(F.lit(f"{k}: "), locator[k].cast("string"))) for k in ("page", "section", "line_start", "line_end", "part")]
    joined = F.array_join(F.array(*parts), " · ")
    return F.when(joined == "", "Document excerpt").otherwise(joined)
