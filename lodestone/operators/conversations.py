"""Conversation state: sequences, history, turns and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.ids import row_id
from lodestone.functions.text import is_follow_up, title
from lodestone.operators.access import visible

#: Fixed value: the title of a conversation before its first question.
UNNAMED = "New Conversation"
MARKER = r"\[\d+\]"


def number_messages(messages: DataFrame) -> DataFrame:
    """messages with sequence, from 1 in each conversation by created_at and id."""
    return messages.withColumn("sequence", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id")))


def next_sequence(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, next_sequence): one after the last, 1 without messages."""
    last = messages.groupBy("conversation_id").agg(F.max("sequence").alias("_last"))
    rows = conversations.select("conversation_id").join(last, "conversation_id", "left")
    return rows.select("conversation_id", (F.coalesce("_last", F.lit(0)) + 1).alias("next_sequence"))


def with_history(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """User messages with history: the complete messages before, at most so many, in order, as structs of role and
    content. The window holds that many complete messages of each conversation, never a whole one."""
    complete = F.col("status") == "complete"
    so_far = F.sum(complete.cast("int")).over(Window.partitionBy("conversation_id").orderBy("sequence"))
    numbered = messages.withColumn("_n", so_far - complete.cast("int"))  # complete ones before it
    near = Window.partitionBy("conversation_id").orderBy("_n").rangeBetween(-settings.recent_history_messages, -1)
    turn = F.when(complete, F.struct("sequence", "role", "content"))
    lists = numbered.withColumn("_before", F.sort_array(F.collect_list(turn).over(near)))
    history = F.transform("_before", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return lists.filter(F.col("role") == "user").withColumn("history", history).drop("_n", "_before")


def resolve(questions: DataFrame) -> DataFrame:
    """questions (content, history, maybe rewrite) with query_text: the rewrite, if it is 1 to 1000 characters long, of a
    follow-up that has a history; else the question."""
    rewrite = F.col("rewrite") if "rewrite" in questions.columns else F.lit(None).cast("string")
    usable = (F.size("history") > 0) & is_follow_up(F.col("content")) & F.char_length(rewrite).between(1, 1000)
    return questions.withColumn("query_text", F.when(F.coalesce(usable, F.lit(False)), rewrite).otherwise(F.col("content")))


def create_turns(conversations: DataFrame, messages: DataFrame, questions: DataFrame, as_of: str, settings: Settings = DEFAULTS) -> DataFrame:
    """What one question to each conversation does, as conversation_id, outcome, user_sequence, assistant_sequence,
    stale_message (an interrupted answer to be marked failed) and title.

    A conversation with an answer under way takes no question, unless that is older than the limit. conversations:
    conversation_id, title; messages: id, conversation_id, sequence, role, status, created_at; questions:
    conversation_id, question.
    """
    now = F.lit(as_of).cast("timestamp")
    fresh = F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(settings.stale_turn_seconds))
    running = messages.filter("role = 'assistant' AND status = 'streaming'").groupBy("conversation_id").agg(F.bool_or(fresh).alias("_fresh"), F.min("id").alias("_running"))
    rows = questions.join(conversations, "conversation_id").join(next_sequence(conversations, messages), "conversation_id").join(running, "conversation_id", "left")
    busy = F.coalesce("_fresh", F.lit(False))
    new_title = F.when(F.col("title") == UNNAMED, title(F.col("question"))).otherwise(F.col("title"))
    return rows.select(
        "conversation_id", F.when(busy, "busy").otherwise("created").alias("outcome"), F.when(~busy, F.col("next_sequence")).alias("user_sequence"),
        F.when(~busy, F.col("next_sequence") + 1).alias("assistant_sequence"), F.when(~busy, F.col("_running")).alias("stale_message"),
        F.when(busy, F.col("title")).otherwise(new_title).alias("title"),
    )


def available_citations(citations: DataFrame, ready: DataFrame) -> DataFrame:
    """citations (with document_id, knowledge_base_id) with source_available and source_url, null where the document is
    gone, not ready, or in another knowledge base. ready: document_id, knowledge_base_id."""
    known = ready.select("document_id", "knowledge_base_id").distinct().withColumn("_ready", F.lit(True))
    there = F.coalesce("_ready", F.lit(False))
    rows = citations.join(known, ["document_id", "knowledge_base_id"], "left")
    url = F.concat(F.lit("/citations/"), F.col("citation_id").cast("string"), F.lit("/source"))
    return rows.withColumn("source_available", there).withColumn("source_url", F.when(there, url)).drop("_ready")


def grouped_citations(citations: DataFrame) -> DataFrame:
    """(message_id, citations): of each message by the number they are cited under."""
    entry = F.struct("citation_number", "citation_id", "document_id", "source_available")
    return citations.groupBy("message_id").agg(F.sort_array(F.collect_list(entry)).alias("citations"))


def citation_payloads(citations: DataFrame) -> DataFrame:
    """citations (of available_citations(), with document_name, locator, excerpt, retrieval_rank, retrieval_score) with payload,
    the JSON that is sent of each: what isn't known is null in it, never left out."""
    item = F.struct(F.col("citation_id").cast("string").alias("id"), "document_name", "locator", "excerpt", "retrieval_rank", "retrieval_score", "source_available", "source_url")
    return citations.withColumn("payload", F.to_json(item, {"ignoreNullFields": "false"}))


def marked_parts(answers: DataFrame) -> DataFrame:
    """The parts of answers (turn_id, content, used: evidence ids by number) from marker to marker, as turn_id, n (from 0),
    part, marker and evidence_id. Texts between markers are parts of their own, empty ones left out; a marker whose number
    nothing is used under stays text, with neither a marker nor evidence. A content that is null has no parts."""
    texts, marks = F.split("content", MARKER), F.regexp_extract_all("content", F.lit(MARKER), 0)  # one text more than marks
    pair = lambda t, m: F.array(F.struct(t.alias("part"), F.lit(False).alias("marks")), F.struct(m.alias("part"), F.lit(True).alias("marks")))
    both = F.filter(F.flatten(F.zip_with(texts, marks, pair)), lambda p: F.coalesce(p["part"], F.lit("")) != "")
    pieces = answers.select("turn_id", "used", F.posexplode(both).alias("n", "p")).select("turn_id", "used", "n", "p.part", "p.marks")
    number = F.when(F.col("marks"), F.regexp_extract("part", r"\d+", 0).try_cast("int"))
    evidence = F.when(number.between(1, F.size("used")), F.try_element_at("used", F.greatest(number, F.lit(1))))
    found = pieces.withColumn("evidence_id", evidence)
    return found.select("turn_id", "n", "part", F.when(F.col("evidence_id").isNotNull(), number).alias("marker"), "evidence_id")


def create_conversations(requests: DataFrame, knowledge_bases: DataFrame, grants: DataFrame, users: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """requests (request_id, owner_id, knowledge_base_id) with outcome: no knowledge base, no access or created; and the new
    conversations (conversation_id, owner_id, knowledge_base_id, title, created_at, updated_at), one a request."""
    there = knowledge_bases.select("knowledge_base_id").distinct().withColumn("_there", F.lit(True))
    rows = requests.join(there, "knowledge_base_id", "left")
    seen = visible(rows.filter("_there"), grants, users).select("request_id", F.lit(True).alias("_seen")).distinct()
    judged = rows.join(seen, "request_id", "left")
    outcome = F.when(F.col("_there").isNull(), "no knowledge base").when(F.col("_seen").isNull(), "no access").otherwise("created")
    found = judged.select("request_id", "owner_id", "knowledge_base_id", outcome.alias("outcome"))
    now = F.lit(as_of).cast("timestamp")
    made = found.filter("outcome = 'created'").select(row_id(F.lit("conversation"), F.col("request_id")).alias("conversation_id"), "owner_id", "knowledge_base_id", F.lit(UNNAMED).alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return found, made
