"""A question turn as one plan: from evidence to a grounded answer, its citations and its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.operators.delivery import FAILED
from lodestone.operators.grounding import NO_EVIDENCE, ground, merge_usage
from lodestone.operators.retrieval import sufficiency

EXCERPT = 1_500
USAGE = "map<string,int>"


def answer_turns(turns: DataFrame, evidence: DataFrame, generations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The answers of turns, as query_id, message_id, outcome, status, generated (whether anything was to be generated),
    content, used (evidence ids by first use), n_evidence and usage.

    turns: query_id, message_id and maybe rewrite_usage; evidence: of retrieve(); generations: query_id, text and maybe
    repair_text, usage, repair_usage. A turn whose evidence isn't sufficient gets a fixed answer without a look at what
    was generated; one with no generated text has failed. All others are held against their evidence.
    """
    usage = F.col("rewrite_usage").cast(USAGE) if "rewrite_usage" in turns.columns else F.lit(None).cast(USAGE)
    asked = turns.select("query_id", "message_id", usage.alias("rewrite_usage"))
    ids = evidence.groupBy("query_id").agg(F.collect_list("evidence_id").alias("evidence_ids"))  # a few a query
    rows = asked.join(sufficiency(evidence, settings, asked), "query_id").join(ids, "query_id", "left").join(generations, "query_id", "left")
    rows = rows.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>"))).withColumnRenamed("query_id", "turn_id")
    none = F.array().cast("array<string>").alias("used")
    plain = lambda some, outcome, text: some.select("turn_id", F.lit(outcome).alias("outcome"), F.lit(text).alias("content"), none, F.lit(None).cast(USAGE).alias("usage"))
    refused = plain(rows.filter("NOT sufficient"), "insufficient_evidence", NO_EVIDENCE)
    failed = plain(rows.filter("sufficient AND text IS NULL"), "generation_failed", FAILED)
    said = ground(rows.filter("sufficient AND text IS NOT NULL").drop("message_id", "rewrite_usage")).drop("rejected")
    mark = lambda some, generated: some.withColumn("generated", F.lit(generated))
    answers = mark(said, True).unionByName(mark(refused, False)).unionByName(mark(failed, True)).withColumnRenamed("turn_id", "query_id")
    status = F.when(F.col("outcome") == "generation_failed", "failed").otherwise("complete")
    found = asked.join(answers, "query_id")
    return found.select("query_id", "message_id", "outcome", status.alias("status"), "generated", "content", "used", F.size("used").alias("n_evidence"), merge_usage(F.col("rewrite_usage"), F.col("usage")).alias("usage"))


def citation_rows(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is stored of the evidence that answers use: query_id, message_id, citation_number, evidence_id, document_id,
    excerpt, retrieval_rank and retrieval_score. evidence: with text and fused_score."""
    used = answers.select("query_id", "message_id", F.posexplode("used").alias("_n", "evidence_id"))
    rows = used.join(evidence, ["query_id", "evidence_id"])
    return rows.select("query_id", "message_id", (F.col("_n") + 1).alias("citation_number"), "evidence_id", "document_id", F.left("text", F.lit(EXCERPT)).alias("excerpt"), "retrieval_rank", F.col("fused_score").alias("retrieval_score"))


def with_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """answers with citations, as turn_events() takes them: of each by number, with the address of its source."""
    url = F.concat(F.lit("/citations/"), F.col("message_id").cast("string"), F.lit("-"), F.col("citation_number").cast("string"), F.lit("/source"))
    item = F.struct("citation_number", "document_id", "excerpt", "retrieval_rank", url.alias("source_url"))
    listed = citations.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("citations"))
    rows = answers.join(listed, "query_id", "left").withColumnRenamed("query_id", "turn_id")
    return rows.withColumn("citations", F.coalesce("citations", F.array().cast(listed.schema["citations"].dataType)))
