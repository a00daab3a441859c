"""Grounding: reading a model's answer, holding it against the evidence, and rendering it with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip

PAYLOAD = "struct<status: string, claims: array<struct<text: string, evidence_ids: array<string>>>>"
# Sentences that answers are made of.
INSUFFICIENT = "I cannot answer reliably from the available Documents. The retrieved evidence does not specifically support an answer to this question."
NO_EVIDENCE = "I cannot answer reliably from the available Documents. No sufficiently relevant evidence was retrieved from Ready Documents in this Knowledge Base."
UNVERIFIABLE = "I cannot answer reliably because the generated response could not be verified against the retrieved Documents. Try rephrasing the question or add more specific Documents."
CONFLICT = "I cannot answer reliably because the retrieved Documents conflict:"
USAGE_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens")
MAX_CLAIMS, MAX_CLAIM_TEXT, MAX_IDS = 12, 2_000, 6


def model_json(text: Column) -> Column:
    """The outermost {...} of a model's text, without its thinking; null where there is none."""
    plain = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def parsed(text: Column) -> Column:
    """The payload in a model's text; null if it isn't JSON of that shape."""
    return F.from_json(model_json(text), PAYLOAD)


def used_ids(claims: Column) -> Column:
    """Evidence ids by first use."""
    return F.array_distinct(F.flatten(F.transform(claims, lambda c: c["evidence_ids"])))


def rejection(payload: Column, available: Column) -> Column:
    """Why an answer is rejected, or null. available: the ids of the evidence."""
    claims = payload["claims"]
    none, n = claims.isNull() | (F.size(claims) == 0), F.size(claims)
    sized = F.forall(claims, lambda c: F.coalesce(F.char_length(c["text"]).between(1, MAX_CLAIM_TEXT) & F.size(c["evidence_ids"]).between(1, MAX_IDS), F.lit(False)))
    known = payload["status"].isin("answer", "insufficient", "conflicting")
    shape = F.coalesce(known, F.lit(False)) & F.when(payload["status"] == "insufficient", none).otherwise(~none & (n <= MAX_CLAIMS) & F.coalesce(sized, F.lit(False)))
    marked = F.exists(claims, lambda c: c["text"].rlike(r"(?i)\[E\d+\]"))
    unknown = F.size(F.array_except(used_ids(claims), available)) > 0
    return (
        F.when(payload.isNull() | ~F.coalesce(shape, F.lit(False)), "format")
        .when(payload["status"] == "insufficient", F.lit(None))
        .when(marked, "own marker")
        .when(unknown, "unknown evidence")
        .when((payload["status"] == "conflicting") & (F.size(used_ids(claims)) < 2), "one-sided conflict")
    )


def rendered(payload: Column) -> Column:
    """An accepted payload as text: each claim with the numbers of its citations, counted by first use."""
    claims, used = payload["claims"], used_ids(payload["claims"])
    number = lambda i: F.concat(F.lit("["), F.array_position(used, i).cast("string"), F.lit("]"))
    lines = F.transform(claims, lambda c: F.concat_ws(" ", strip(c["text"]), F.array_join(F.transform(c["evidence_ids"], number), " ")))
    conflict = F.concat(F.lit(f"{CONFLICT}\n\n- "), F.array_join(lines, "\n\n- "))
    return F.when(payload["status"] == "insufficient", INSUFFICIENT).when(payload["status"] == "conflicting", conflict).otherwise(F.array_join(lines, "\n\n"))


def ground(answers: DataFrame) -> DataFrame:
    """answers (turn_id, text, evidence_ids, and maybe repair_text, usage, repair_usage) as turn_id, outcome, content,
    used (evidence ids by first use), rejected (why the first text was) and usage.

    A rejected text gives way to its repair if that is accepted, with the usage of both; else the answer is refused, with
    the usage of the first alone.
    """
    have = answers.columns
    get = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    rows = answers.select("turn_id", "evidence_ids", parsed(F.col("text")).alias("first"), parsed(get("repair_text", "string")).alias("second"), get("usage", "map<string,int>").alias("usage"), get("repair_usage", "map<string,int>").alias("repair_usage"))
    rows = rows.select(F.explode(F.array(F.struct("*"))).alias("_")).select("_.*")  # texts are parsed once, not for each use of them
    rows = rows.withColumn("why", rejection(F.col("first"), F.col("evidence_ids"))).withColumn("again", rejection(F.col("second"), F.col("evidence_ids")))
    rows = rows.select(F.explode(F.array(F.struct("*"))).alias("_")).select("_.*")
    rows = rows.withColumn("mended", F.col("why").isNotNull() & F.col("again").isNull() & F.col("second").isNotNull())
    rows = rows.withColumn("payload", F.when(F.col("why").isNull(), F.col("first")).when(F.col("mended"), F.col("second")))
    payload = F.col("payload")
    outcome = F.when(payload.isNull(), "validation_rejected").when(payload["status"] == "insufficient", "insufficient_evidence").when(payload["status"] == "conflicting", "conflicting_evidence").otherwise("grounded_answer")
    content = F.when(payload.isNull(), UNVERIFIABLE).otherwise(rendered(payload))
    used = F.when(payload["status"] != "insufficient", used_ids(payload["claims"]))
    usage = F.when(F.col("mended"), merge_usage(F.col("usage"), F.col("repair_usage"))).otherwise(F.col("usage"))
    return rows.select("turn_id", outcome.alias("outcome"), content.alias("content"), F.coalesce(used, F.array().cast("array<string>")).alias("used"), F.col("why").alias("rejected"), usage.alias("usage"))


def usage_of(response: Column) -> Column:
    """The counted tokens in a provider's response."""
    usage = F.from_json(F.get_json_object(response, "$.usage"), "map<string,string>")
    whole = F.map_filter(usage, lambda k, v: k.isin(*USAGE_KEYS) & F.coalesce(v.rlike(r"^-?\d+$"), F.lit(False)))
    return F.coalesce(F.transform_values(whole, lambda k, v: v.cast("int")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))


def merge_usage(a: Column, b: Column) -> Column:
    """Two counts, key by key; what one lacks counts as 0."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


ANSWER_TASK = "Answer from the evidence alone. Give a JSON object with status (answer, insufficient or conflicting) and claims, each with text and evidence_ids. Write no citation markers."
REWRITE_TASK = "Put the last question into words that can be searched for without the turns before it. Give a JSON object with query."
REPAIR_TASK = "The answer before was rejected. Give a JSON object of the same shape that the evidence supports."


def answer_prompt(question: Column, history: Column, evidence: Column) -> Column:
    """The request to a model as JSON: what it is to do, the turns before, and the evidence by id."""
    return F.to_json(F.struct(F.lit(ANSWER_TASK).alias("instruction"), question.alias("question"), history.alias("history"), evidence.alias("evidence")))


def request_body(messages: Column, model: Column, stream: bool, max_tokens: int) -> Column:
    """What is sent to a provider of chat completions, as JSON: messages (an array of role and content) in order, for an
    answer of JSON, always the likeliest, without reasoning."""
    fixed = [F.lit(stream).alias("stream"), F.lit(0.0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit("none").alias("reasoning_effort"), F.struct(F.lit("json_object").alias("type")).alias("response_format")]
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), *fixed))


def rewrite_prompt(question: Column, history: Column) -> Column:
    """The request to put a follow-up into words of its own."""
    return F.to_json(F.struct(F.lit(REWRITE_TASK).alias("instruction"), question.alias("question"), history.alias("history")))


def repair_prompt(question: Column, evidence: Column, rejected: Column) -> Column:
    """The request for another answer, with why the first was rejected."""
    return F.to_json(F.struct(F.lit(REPAIR_TASK).alias("instruction"), question.alias("question"), evidence.alias("evidence"), rejected.alias("rejected")))
