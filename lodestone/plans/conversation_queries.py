"""Queries over conversations: turns, history, delivery, grounding and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_follow_up, title
from lodestone.operators import conversations, delivery, grounding
from lodestone.plans.catalog import query, table

#: One turn a minute from this moment on.
START = "2024-01-01 00:00:00"
AS_OF = "2024-01-01 00:20:00"
FOLLOW = r"(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) <= 20 AND (regexp_matches(text, '^\s*(and\b|also\b|what about\b|how about\b|what else\b)', 'i') OR regexp_matches(text, '\b(it|its|this|that|these|those|they|them|same|former|latter)\b', 'i')))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages; an assistant's third turn and later ones of a conversation divisible by 5 are under way."""
    rows = table(spark, sf_dir, "conversations")
    created = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit(START).cast("timestamp"))
    last = Window.partitionBy("conv_id")
    running = (F.col("role") == "assistant") & (F.col("conv_id") % 5 == 0) & (F.col("turn") == F.max("turn").over(last))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).cast("int").alias("sequence"),
        "role", F.when(running, "streaming").otherwise("complete").alias("status"), F.col("text").alias("content"), created.alias("created_at"),
    )


MESSAGES = """messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, (turn + 1)::INTEGER AS sequence, role,
  CASE WHEN role = 'assistant' AND conv_id % 5 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN 'streaming' ELSE 'complete' END AS status,
  text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at FROM conversations)"""


@query("SELECT conv_id AS conversation_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn)::INTEGER AS sequence FROM conversations")
def message_sequence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages numbered by time within their conversation."""
    rows = messages(spark, sf_dir).drop("sequence")
    return conversations.number_messages(rows).select("conversation_id", (F.col("id") % 1000).alias("turn"), "sequence")


@query("SELECT conv_id AS conversation_id, (max(turn) + 2)::INTEGER AS next_sequence FROM conversations GROUP BY 1")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return conversations.next_sequence(rows.select("conversation_id").distinct(), rows)


@query(f"""WITH {MESSAGES} SELECT u.conversation_id, u.sequence, count(h.id)::INTEGER AS n_history,
  coalesce(string_agg(h.role || ':' || length(h.content), ',' ORDER BY h.sequence), '') AS shape
FROM messages u LEFT JOIN LATERAL (SELECT * FROM messages m WHERE m.conversation_id = u.conversation_id AND m.sequence < u.sequence AND m.status = 'complete' ORDER BY m.sequence DESC LIMIT 8) h ON true
WHERE u.role = 'user' GROUP BY 1, 2""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question has before it: at most eight complete messages."""
    rows = conversations.with_history(messages(spark, sf_dir))
    shape = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.char_length(h["content"]).cast("string")))
    return rows.select("conversation_id", "sequence", F.size("history").alias("n_history"), F.array_join(shape, ",").alias("shape"))


@query(f"SELECT conv_id AS conversation_id, turn, turn > 0 AND {FOLLOW} AS follow_up FROM conversations WHERE role = 'user'")
def followup_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select(F.col("conv_id").alias("conversation_id"), "turn", ((F.col("turn") > 0) & is_follow_up(F.col("text"))).alias("follow_up"))


@query(f"""WITH {MESSAGES}, u AS (SELECT m.*, m.content AS text, (SELECT count(*) FROM messages b WHERE b.conversation_id = m.conversation_id AND b.sequence < m.sequence AND b.status = 'complete') AS n FROM messages m WHERE role = 'user')
SELECT conversation_id, sequence, CASE WHEN n > 0 AND {FOLLOW} THEN left('about ' || conversation_id || ': ' || text, 1000) ELSE text END AS query_text FROM u""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as they are searched for: follow-ups give way to what a model (here: a prefix) makes of them."""
    rows = conversations.with_history(messages(spark, sf_dir))
    rewrite = F.left(F.concat(F.lit("about "), F.col("conversation_id").cast("string"), F.lit(": "), F.col("content")), F.lit(1000))
    return conversations.resolve(rows.withColumn("rewrite", rewrite)).select("conversation_id", "sequence", "query_text")


@query("""SELECT conv_id AS conversation_id, left(arg_min(text, turn), 157) || CASE WHEN length(arg_min(text, turn)) > 157 THEN '...' ELSE '' END AS title FROM conversations WHERE role = 'user' GROUP BY 1""")
def conversation_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.min_by("text", "turn").alias("q")).select("conversation_id", title(F.col("q")).alias("title"))


@query("SELECT conv_id AS conversation_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_questions, max(turn) AS last_turn, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def turn_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("conversation_id"))
    return rows.agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_questions"), F.max("turn").alias("last_turn"), F.sum(F.char_length("text")).alias("n_chars"))


@query(f"""WITH {MESSAGES}, s AS (SELECT conversation_id, max(sequence) + 1 AS n, min(id) FILTER (role = 'assistant' AND status = 'streaming') AS running, bool_or(role = 'assistant' AND status = 'streaming' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 SECOND) AS busy,
  arg_min(content, sequence) AS q FROM messages GROUP BY 1)
SELECT conversation_id, CASE WHEN busy THEN 'busy' ELSE 'created' END AS outcome, CASE WHEN NOT busy THEN n END::INTEGER AS user_sequence, CASE WHEN NOT busy THEN n + 1 END::INTEGER AS assistant_sequence,
  CASE WHEN NOT busy THEN running END AS stale_message, CASE WHEN busy OR conversation_id % 2 = 1 THEN CASE WHEN conversation_id % 2 = 1 THEN 'Named' ELSE 'New Conversation' END ELSE left(q, 157) || CASE WHEN length(q) > 157 THEN '...' ELSE '' END END AS title FROM s""")
def stale_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is asked its first question again, twenty minutes on."""
    rows = messages(spark, sf_dir)
    named = F.when(F.col("conversation_id") % 2 == 1, "Named").otherwise("New Conversation")
    owned = rows.select("conversation_id").distinct().select("conversation_id", named.alias("title"))
    asked = rows.groupBy("conversation_id").agg(F.min_by("content", "sequence").alias("question"))
    return conversations.create_turns(owned, rows, asked, AS_OF)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant message cites three documents, by number of use; what they stand for moves with the message."""
    rows = messages(spark, sf_dir).filter("role = 'assistant'")
    cited = rows.select(F.col("id").alias("message_id"), "conversation_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("citation_number"))
    document = F.pmod(F.col("message_id") * 7 + F.col("citation_number") * 13, F.lit(1000))
    return cited.select("message_id", "conversation_id", "citation_number", (F.col("message_id") * 10 + F.col("citation_number")).alias("citation_id"), document.alias("document_id"), F.concat(F.lit("src"), F.pmod(document, F.lit(20)).cast("string")).alias("knowledge_base_id"))


CITATIONS = f"""{MESSAGES}, cited AS (SELECT id AS message_id, conversation_id, unnest([1, 2, 3]) AS citation_number FROM messages WHERE role = 'assistant'),
numbered AS (SELECT *, message_id * 10 + citation_number AS citation_id, (message_id * 7 + citation_number * 13) % 1000 AS document_id, 'src' || ((message_id * 7 + citation_number * 13) % 1000 % 20) AS kb FROM cited),
citations AS (SELECT n.*, l.doc_id IS NOT NULL AS source_available FROM numbered n LEFT JOIN (SELECT DISTINCT l.doc_id, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1) l ON l.doc_id = n.document_id AND l.source = n.kb)"""


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("knowledge_base_id"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    return docs.join(good, "document_id", "left_semi")


@query(f"WITH {CITATIONS} SELECT citation_id, document_id, source_available, CASE WHEN source_available THEN '/citations/' || citation_id || '/source' END AS source_url FROM citations")
def citation_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.available_citations(citations(spark, sf_dir), ready(spark, sf_dir))
    return rows.select("citation_id", "document_id", "source_available", "source_url")


@query(f"WITH {CITATIONS} SELECT message_id, string_agg(citation_number || '=' || document_id || CASE WHEN source_available THEN '+' ELSE '-' END, ' ' ORDER BY citation_number) AS citations FROM citations GROUP BY 1")
def citation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.grouped_citations(conversations.available_citations(citations(spark, sf_dir), ready(spark, sf_dir)))
    entry = lambda c: F.concat(c["citation_number"].cast("string"), F.lit("="), c["document_id"].cast("string"), F.when(c["source_available"], "+").otherwise("-"))
    return rows.select("message_id", F.array_join(F.transform("citations", entry), " ").alias("citations"))


@query(f"""WITH {CITATIONS}, g AS (SELECT message_id, string_agg(citation_id::VARCHAR, ' ' ORDER BY citation_number) AS citations FROM citations GROUP BY 1)
SELECT conversation_id, id AS message_id, sequence, role, status, coalesce(citations, '') AS citations FROM messages LEFT JOIN g ON message_id = id""")
def conversation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in order, each with its citations, in one plan."""
    grouped = conversations.grouped_citations(conversations.available_citations(citations(spark, sf_dir), ready(spark, sf_dir)))
    ids = F.array_join(F.transform("citations", lambda c: c["citation_id"].cast("string")), " ")
    rows = messages(spark, sf_dir).withColumnRenamed("id", "message_id").join(grouped.select("message_id", ids.alias("citations")), "message_id", "left")
    return rows.select("conversation_id", "message_id", "sequence", "role", "status", F.coalesce("citations", F.lit("")).alias("citations"))


@query(f"""WITH {CITATIONS} SELECT citation_id, CASE WHEN c.document_id >= (SELECT count(*) FROM documents) THEN 404 WHEN source_available THEN 200 ELSE 410 END::INTEGER AS status FROM citations c""")
def citation_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request for a citation's source is answered: 200, 410 where the source is there no more, 404 where it never was."""
    rows = conversations.available_citations(citations(spark, sf_dir), ready(spark, sf_dir))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("_known"))
    joined = rows.join(known, "document_id", "left")
    return joined.select("citation_id", F.when(F.col("_known").isNull(), 404).when(F.col("source_available"), 200).otherwise(410).alias("status"))


def all_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same citations of documents from the whole table, and of some that never were in it."""
    n = table(spark, sf_dir, "documents").agg(F.floor(F.count("*") * 5 / 4).alias("_n"))
    rows = citations(spark, sf_dir).join(F.broadcast(n))  # one row
    document = F.pmod(F.col("message_id") * 7 + F.col("citation_number") * 13, F.col("_n"))
    return rows.withColumn("document_id", document).withColumn("knowledge_base_id", F.concat(F.lit("src"), F.pmod("document_id", F.lit(20)).cast("string"))).drop("_n")


ALL_CITATIONS = CITATIONS.replace("% 1000", "% (SELECT count(*) * 5 // 4 FROM documents)")


@query(f"WITH {ALL_CITATIONS} SELECT citation_id, document_id, source_available, CASE WHEN source_available THEN '/citations/' || citation_id || '/source' END AS source_url FROM citations")
def citation_availability_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability of citations from the whole table of documents."""
    rows = conversations.available_citations(all_citations(spark, sf_dir), ready(spark, sf_dir))
    return rows.select("citation_id", "document_id", "source_available", "source_url")


@query(f"""WITH {ALL_CITATIONS} SELECT citation_id, CASE WHEN c.document_id >= (SELECT count(*) FROM documents) THEN 404 WHEN source_available THEN 200 ELSE 410 END::INTEGER AS status FROM citations c""")
def citation_download_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to requests for all of these, with each of the three occurring."""
    rows = conversations.available_citations(all_citations(spark, sf_dir), ready(spark, sf_dir))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("_known"))
    joined = rows.join(known, "document_id", "left")
    return joined.select("citation_id", F.when(F.col("_known").isNull(), 404).when(F.col("source_available"), 200).otherwise(410).alias("status"))


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations WHERE role = 'assistant'),
d AS (SELECT turn_id, text, unnest(generate_series(0, (length(text) - 1) // 120)) AS i FROM a WHERE text <> '')
SELECT turn_id, (i + 2)::INTEGER AS n, substr(text, i * 120 + 1, 120) AS delta FROM d""")
def sse_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as events; here the slices of their texts."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    turn = (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id")
    answers = rows.select(turn, turn.alias("message_id"), F.col("text").alias("content"), F.lit("grounded_answer").alias("outcome"), F.lit(True).alias("generated"), F.array().cast("array<struct<n: int>>").alias("citations"))
    events = delivery.turn_events(answers).filter("event = 'delta'")
    return events.select("turn_id", (F.col("n") - 2).alias("n"), F.get_json_object("data", "$.content").alias("delta"))  # behind three stages and the start


@query("""WITH b AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, role, text FROM conversations)
SELECT conv_id AS stream_id, role AS event, count(*) AS n_events, sum(length(replace(text, chr(13), '')) ) ::BIGINT AS n_chars FROM b WHERE turn < n - 1 GROUP BY 1, 2""")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as event streams, whose last event is cut off, and read again."""
    rows = table(spark, sf_dir, "conversations")
    data = F.concat(F.lit("event: "), F.col("role"), F.lit("\n"), F.array_join(F.transform(F.split(F.col("text"), "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", data.alias("d")))), lambda x: x["d"])
    streams = rows.groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_join(ordered, "\n\n").alias("text"))
    found = delivery.parse_events(streams)
    return found.groupBy("stream_id", "event").agg(F.count("*").alias("n_events"), F.sum(F.char_length("data")).alias("n_chars"))


#: As much of a text as has its first six words, whatever else stands between: a line break at the start makes an empty one.
BEGINNING = r"^[^\p{L}]*+(?:\p{L}[^ \n]*+[ \n]*+[^\p{L}]*+){0,7}"


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer to each document: its first words as claims, in ways that are right or wrong by turns."""
    first_words = F.slice(F.split(F.trim(F.regexp_replace(F.regexp_extract("text", BEGINNING, 0), r"[^\p{L}\n ]", "")), r"\s+"), 1, 6)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(7)).alias("kind"), F.explode(F.array(first_words)).alias("w"))  # words are found once, not for each use of them
    words = lambda a, b: F.trim(F.array_join(F.slice("w", a, b), " "))
    text = lambda a, b: F.when(words(a, b) == "", "none").otherwise(words(a, b))
    ids = lambda *x: F.array(*map(F.lit, x))
    claim = lambda t, i: F.struct(t.alias("text"), i.alias("evidence_ids"))
    first = F.when(F.col("kind") == 3, F.concat(text(1, 3), F.lit(" [E1]"))).otherwise(text(1, 3))
    one, two = claim(first, F.when(F.col("kind") == 4, ids("E9")).otherwise(ids("E2", "E1"))), claim(text(4, 3), ids("E2"))
    claims = F.when(F.col("kind") == 1, F.array().cast("array<struct<text: string, evidence_ids: array<string>>>")).when(F.col("kind") == 5, F.array(two)).otherwise(F.array(one, two))
    status = F.when(F.col("kind") == 1, "insufficient").when(F.col("kind").isin(2, 5), "conflicting").when(F.col("kind") == 6, "maybe").otherwise("answer")
    payload = F.to_json(F.struct(status.alias("status"), claims.alias("claims")))
    said = F.concat(F.lit("<think>{not this}</think> Here: "), payload, F.lit(" Done."))
    return docs.select("doc_id", "kind", F.explode(F.array(said)).alias("text"), "w").select("doc_id", "kind", "text", text(1, 3).alias("a"), text(4, 3).alias("b"))


SAID = r"""w AS (SELECT doc_id, doc_id % 7 AS kind, regexp_split_to_array(trim(regexp_replace(text, '[^\p{L}\n ]', '', 'g')), '\s+')[1:6] AS w FROM documents),
said AS (SELECT doc_id, kind, coalesce(nullif(trim(array_to_string(w[1:3], ' ')), ''), 'none') AS a, coalesce(nullif(trim(array_to_string(w[4:6], ' ')), ''), 'none') AS b FROM w)"""


@query(f"WITH {SAID} SELECT doc_id, CASE kind WHEN 1 THEN 'insufficient' WHEN 2 THEN 'conflicting' WHEN 5 THEN 'conflicting' WHEN 6 THEN 'maybe' ELSE 'answer' END AS status, CASE kind WHEN 1 THEN 0 WHEN 5 THEN 1 ELSE 2 END::INTEGER AS n_claims FROM said")
def model_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in a model's text, past its thinking."""
    payload = grounding.parsed(F.col("text"))
    return model_texts(spark, sf_dir).select("doc_id", payload["status"].alias("status"), F.size(payload["claims"]).alias("n_claims"))


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_texts(spark, sf_dir).select(F.col("doc_id").alias("turn_id"), "text", F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")).alias("evidence_ids"))
    return grounding.ground(rows)


@query(f"WITH {SAID} SELECT doc_id AS turn_id, CASE kind WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'conflicting_evidence' WHEN 0 THEN 'grounded_answer' ELSE 'validation_rejected' END AS outcome, CASE kind WHEN 3 THEN 'own marker' WHEN 4 THEN 'unknown evidence' WHEN 5 THEN 'one-sided conflict' WHEN 6 THEN 'format' END AS rejected FROM said")
def grounding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded(spark, sf_dir).select("turn_id", "outcome", "rejected")


@query(f"""WITH {SAID} SELECT doc_id AS turn_id, CASE kind WHEN 0 THEN a || ' [1] [2]' || chr(10) || chr(10) || b || ' [1]' WHEN 2 THEN '{grounding.CONFLICT}' || chr(10) || chr(10) || '- ' || a || ' [1] [2]' || chr(10) || chr(10) || '- ' || b || ' [1]'
  WHEN 1 THEN '{grounding.INSUFFICIENT}' ELSE '{grounding.UNVERIFIABLE}' END AS content, CASE WHEN kind IN (0, 2) THEN 'E2,E1' ELSE '' END AS used FROM said""")
def grounding_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded(spark, sf_dir).select("turn_id", "content", F.array_join("used", ",").alias("used"))


@query(f"""WITH {SAID} SELECT doc_id AS turn_id, list_position([1, 2], n)::INTEGER AS marker, CASE n WHEN 1 THEN 'E2' ELSE 'E1' END AS evidence_id, count(*) AS n_marks FROM (SELECT doc_id, kind, unnest([1, 2, 1]) AS n FROM said WHERE kind IN (0, 2)) GROUP BY 1, 2, 3""")
def marker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in rendered answers, and the evidence that each stands for."""
    rows = grounded(spark, sf_dir).filter(F.size("used") > 0)
    marks = rows.select("turn_id", "used", F.explode(F.regexp_extract_all("content", F.lit(r"\[(\d+)\]"), 1)).alias("m"))
    found = marks.select("turn_id", F.col("m").cast("int").alias("marker"), F.element_at("used", F.col("m").cast("int")).alias("evidence_id"))
    return found.groupBy("turn_id", "marker", "evidence_id").agg(F.count("*").alias("n_marks"))


@query("""SELECT doc_id, (doc_id % 50 + n_chars % 30)::INTEGER AS prompt_tokens, (n_chars % 30 + CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 0 END)::INTEGER AS completion_tokens, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 0 END::INTEGER AS total_tokens FROM documents""")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of two responses, added by key; other keys and values that are no whole numbers don't count."""
    docs = table(spark, sf_dir, "documents")
    one = F.to_json(F.struct(F.struct(F.pmod("doc_id", F.lit(50)).alias("prompt_tokens"), F.lit("x").alias("total_tokens"), F.pmod("n_chars", F.lit(30)).alias("completion_tokens"), F.lit(5).alias("cached")).alias("usage")))
    two = F.to_json(F.struct(F.struct(F.pmod("n_chars", F.lit(30)).alias("prompt_tokens"), F.when(F.pmod("doc_id", F.lit(2)) == 0, 7).alias("completion_tokens"), F.when(F.pmod("doc_id", F.lit(2)) == 0, 9).alias("total_tokens")).alias("usage")))
    merged = docs.select("doc_id", grounding.merge_usage(grounding.usage_of(one), grounding.usage_of(two)).alias("u"))
    return merged.select("doc_id", *(F.coalesce(F.element_at("u", k), F.lit(0)).alias(k) for k in grounding.USAGE_KEYS))
