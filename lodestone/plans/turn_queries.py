"""Queries over whole turns: from evidence to answers, citations and events; and over providers' streams and prompts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import conversations, delivery, grounding, retrieval, turns
from lodestone.plans.catalog import query, table
from lodestone.plans.conversation_queries import MESSAGES, messages
from lodestone.plans.retrieval_queries import RANKED_SQL, evidence, hybrid_chunks, hybrid_queries

#: What a model says to each query, by its number: a pair of claims that cite two pieces of evidence, that there is too
#: little, evidence that isn't there (and a good repair), nothing, one claim, and no JSON.
KINDS = 6


def kind(query_id: Column) -> Column:
    return F.pmod(F.floor(query_id / 100), F.lit(KINDS))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hybrid_queries(spark, sf_dir).select("query_id", kind(F.col("query_id")).alias("kind"))
    claim = lambda text, *ids: json.dumps({"status": "answer", "claims": [{"text": text, "evidence_ids": ids}]})
    said = F.when(F.col("kind") == 0, claim("First.", "E2", "E1")).when(F.col("kind") == 1, '{"status":"insufficient","claims":[]}').when(F.col("kind") == 2, claim("First.", "E99"))
    said = said.when(F.col("kind") == 4, claim("Second.", "E1")).when(F.col("kind") == 5, "no JSON")
    return rows.select("query_id", said.alias("text"), F.when(F.col("kind") == 2, claim("Second.", "E1")).alias("repair_text"))


def answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The answers of all queries, and their evidence with texts."""
    asked = hybrid_queries(spark, sf_dir).select("query_id", (F.col("query_id") * 10).alias("message_id"))
    found = evidence(spark, sf_dir)
    texts = hybrid_chunks(spark, sf_dir).select("chunk_id", "text")
    return turns.answer_turns(asked, found, generations(spark, sf_dir)), found.join(texts, "chunk_id")


ANSWERS_SQL = RANKED_SQL + f""", enough AS (SELECT a.query_id, coalesce(bool_or(similarity >= 0.28 OR lexical_score >= 0.01), false) AS sufficient, count(e.query_id) AS n FROM asked a LEFT JOIN evidence e ON e.query_id = a.query_id GROUP BY 1),
kinds AS (SELECT *, (query_id // 100) % {KINDS} AS kind FROM enough),
good AS (SELECT *, sufficient AND (kind IN (2, 4) OR kind = 0 AND n >= 2) AS good FROM kinds),
answers AS (SELECT query_id, kind, sufficient, CASE WHEN NOT sufficient OR kind = 1 THEN 'insufficient_evidence' WHEN kind = 3 THEN 'generation_failed' WHEN good THEN 'grounded_answer' ELSE 'validation_rejected' END AS outcome,
  CASE WHEN NOT sufficient THEN 'I cannot answer reliably from the available Documents. No sufficiently relevant evidence was retrieved from Ready Documents in this Knowledge Base.'
    WHEN kind = 1 THEN 'I cannot answer reliably from the available Documents. The retrieved evidence does not specifically support an answer to this question.' WHEN kind = 3 THEN '{delivery.FAILED}' WHEN good AND kind = 0 THEN 'First. [1] [2]' WHEN good THEN 'Second. [1]' ELSE '{grounding.UNVERIFIABLE}' END AS content,
  CASE WHEN good AND kind = 0 THEN ['E2', 'E1'] WHEN good THEN ['E1'] ELSE []::VARCHAR[] END AS used FROM good)"""


@query(RANKED_SQL + """ SELECT a.query_id, coalesce(bool_or(similarity >= 0.28 OR lexical_score >= 0.01), false) AS sufficient, count(e.query_id) AS n_evidence FROM asked a LEFT JOIN evidence e ON e.query_id = a.query_id GROUP BY 1""")
def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query, whether it has evidence or not: is there enough?"""
    return retrieval.sufficiency(evidence(spark, sf_dir), queries=hybrid_queries(spark, sf_dir))


@query(ANSWERS_SQL + " SELECT query_id, outcome, CASE WHEN outcome = 'generation_failed' THEN 'failed' ELSE 'complete' END AS status, content, array_to_string(used, ',') AS used FROM answers")
def answer_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of every query: refused without evidence, failed, repaired, rejected or grounded."""
    return answered(spark, sf_dir)[0].select("query_id", "outcome", "status", "content", F.array_join("used", ",").alias("used"))


@query(ANSWERS_SQL + """, cited AS (SELECT query_id, unnest(used) AS evidence_id, generate_subscripts(used, 1) AS citation_number FROM answers)
SELECT c.query_id, c.query_id * 10 AS message_id, c.citation_number::INTEGER AS citation_number, c.evidence_id, e.document_id, e.retrieval_rank, e.fused_score AS retrieval_score, md5(left(d.text, 1500)) AS excerpt
FROM cited c JOIN evidence e ON e.query_id = c.query_id AND 'E' || e.retrieval_rank = c.evidence_id JOIN documents d ON d.doc_id = e.chunk_id""")
def persisted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations that are stored with the answers."""
    rows = turns.citation_rows(*answered(spark, sf_dir))
    return rows.withColumn("excerpt", F.md5(F.col("excerpt").cast("binary")))


@query(ANSWERS_SQL + """, stages AS (SELECT query_id, sufficient, outcome, content, len(used) AS n_cited, CASE WHEN NOT sufficient THEN 1 WHEN outcome = 'generation_failed' THEN 2 ELSE 3 END AS n_stages, CASE WHEN sufficient THEN 120 ELSE 10000 END AS slice FROM answers),
events AS (SELECT query_id, i - 1 AS n, 'status' AS event, ['retrieving', 'generating', 'validating'][i] AS value FROM (SELECT *, unnest(generate_series(1, n_stages)) AS i FROM stages)
UNION ALL SELECT query_id, 2, 'error', content FROM stages WHERE outcome = 'generation_failed'
UNION ALL SELECT query_id, n_stages, 'start', (query_id * 10)::VARCHAR FROM stages WHERE outcome <> 'generation_failed'
UNION ALL SELECT query_id, n_stages + 1 + k, 'delta', substr(content, k * slice + 1, slice) FROM (SELECT *, unnest(generate_series(0, (length(content) - 1) // slice)) AS k FROM stages WHERE outcome <> 'generation_failed')
UNION ALL SELECT query_id, n_stages + 2 + (length(content) - 1) // slice, 'citations', n_cited::VARCHAR FROM stages WHERE outcome <> 'generation_failed'
UNION ALL SELECT query_id, n_stages + 3 + (length(content) - 1) // slice, 'done', outcome FROM stages WHERE outcome <> 'generation_failed')
SELECT query_id, n::INTEGER AS n, event, value FROM events""")
def turn_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that each answer is sent as."""
    answers, found = answered(spark, sf_dir)
    events = delivery.turn_events(turns.with_citations(answers, turns.citation_rows(answers, found)))
    get = lambda k: F.get_json_object("data", f"$.{k}")
    items = F.json_array_length(get("items")).cast("string")
    return events.select(F.col("turn_id").alias("query_id"), F.col("n"), "event", F.coalesce(get("stage"), get("message_id"), get("content"), items, get("outcome"), get("message")).alias("value"))


@query("""SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text, max(turn)::INTEGER AS prompt_tokens FROM conversations WHERE turn < 6 GROUP BY 1""")
def provider_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as providers' streams, a turn to a piece, with the usage in each and pieces after the end."""
    piece = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"), F.struct(F.col("turn").alias("prompt_tokens")).alias("usage"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.when(F.col("turn") < 6, F.col("turn")).otherwise(F.col("turn") + 1).cast("int").alias("n"), F.to_json(piece).alias("data"))
    ends = rows.select("stream_id").distinct().select("stream_id", F.lit(6).alias("n"), F.lit("[DONE]").alias("data"))
    found = delivery.completion_text(rows.unionByName(ends))
    return found.select("stream_id", "text", F.element_at("usage", "prompt_tokens").alias("prompt_tokens"))


@query(f"""WITH {MESSAGES} SELECT u.conversation_id, u.sequence, u.content AS question, count(h.id)::INTEGER AS n_history, 'E1' AS evidence_id, 'own marker' AS rejected
FROM messages u LEFT JOIN LATERAL (SELECT * FROM messages m WHERE m.conversation_id = u.conversation_id AND m.sequence < u.sequence AND m.status = 'complete' ORDER BY m.sequence DESC LIMIT 8) h ON true WHERE u.role = 'user' GROUP BY 1, 2, 3""")
def prompt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three requests that a question can lead to, read back."""
    rows = conversations.with_history(messages(spark, sf_dir))
    sources = F.array(F.struct(F.lit("E1").alias("evidence_id"), F.col("content").alias("text")))
    made = rows.select("conversation_id", "sequence", grounding.answer_prompt(F.col("content"), F.col("history"), sources).alias("a"), grounding.rewrite_prompt(F.col("content"), F.col("history")).alias("b"), grounding.repair_prompt(F.col("content"), sources, F.lit("own marker")).alias("c"))
    get = F.get_json_object
    return made.select("conversation_id", "sequence", get("a", "$.question").alias("question"), F.json_array_length(get("b", "$.history")).alias("n_history"), get("a", "$.evidence[0].evidence_id").alias("evidence_id"), get("c", "$.rejected").alias("rejected"))


@query(f"""WITH {MESSAGES} SELECT u.conversation_id, u.sequence, 'a-model' AS model, count(h.id)::INTEGER + 2 AS n_messages, 'system' AS first_role, u.content AS last_content, true AS stream, 0.0::DOUBLE AS temperature, 1200 AS max_tokens, 'none' AS reasoning, 'json_object' AS format
FROM messages u LEFT JOIN LATERAL (SELECT * FROM messages m WHERE m.conversation_id = u.conversation_id AND m.sequence < u.sequence AND m.status = 'complete' ORDER BY m.sequence DESC LIMIT 8) h ON true WHERE u.role = 'user' GROUP BY 1, 2, 3, 6""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each question's request, with the turns before it, read back."""
    rows = conversations.with_history(messages(spark, sf_dir))
    said = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    turns_before = F.transform("history", lambda h: said(h["role"], h["content"]))
    all_ = F.concat(F.array(said(F.lit("system"), F.lit(grounding.ANSWER_TASK))), turns_before, F.array(said(F.lit("user"), F.col("content"))))
    body = rows.select("conversation_id", "sequence", grounding.request_body(all_, F.lit("a-model"), True, 1_200).alias("body"))
    read = body.select("conversation_id", "sequence", F.from_json("body", "model string, messages array<struct<role: string, content: string>>, stream boolean, temperature double, max_tokens int, reasoning_effort string, response_format struct<type: string>").alias("b"))
    return read.select(
        "conversation_id", "sequence", "b.model", F.size("b.messages").alias("n_messages"), F.element_at("b.messages", 1)["role"].alias("first_role"), F.element_at("b.messages", -1)["content"].alias("last_content"),
        "b.stream", "b.temperature", "b.max_tokens", F.col("b.reasoning_effort").alias("reasoning"), F.col("b.response_format.type").alias("format"),
    )
