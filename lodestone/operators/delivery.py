"""Answers as event streams, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.grounding import usage_of

#: Characters of a model's answer beyond which it is refused.
MAX_COMPLETION = 100_000
SLICE = 120
# Fixed value: what an answer that failed says.
FAILED = "The answer could not be generated. Please try again later."


def frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def turn_events(answers: DataFrame) -> DataFrame:
    """(turn_id, n, event, data) of answers (turn_id, message_id, outcome, generated, content, citations: an array of
    structs).

    A status for each stage, start with the message, the content in slices of 120 characters, the citations, and done.
    One for which nothing was generated has the first stage only and its whole content at once; one that failed (outcome
    generation_failed) has the first two stages and an error.
    """
    text, outcome = F.col("content"), F.col("outcome")
    make = lambda event, **data: F.struct(F.lit(event).alias("event"), F.to_json(F.struct(*(v.alias(k) for k, v in data.items()))).alias("data"))
    stage = lambda name: make("status", stage=F.lit(name))
    length = F.when(~F.col("generated"), F.greatest(F.char_length(text), F.lit(1))).otherwise(SLICE)
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text), length)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(starts, lambda i: make("delta", content=F.substring(text, i, length)))
    start = make("start", message_id=F.col("message_id").cast("string"), status=F.lit("complete"))
    ended = F.array(make("citations", items=F.col("citations")), make("done", outcome=outcome))
    brief = F.concat(F.array(stage("retrieving"), start), deltas, ended)
    whole = F.concat(F.array(stage("retrieving"), stage("generating"), stage("validating"), start), deltas, ended)
    broken = F.array(stage("retrieving"), stage("generating"), make("error", message=F.lit(FAILED)))
    events = F.when(outcome == "generation_failed", broken).when(~F.col("generated"), brief).otherwise(whole)
    return answers.select("turn_id", F.posexplode(events).alias("n", "e")).select("turn_id", "n", "e.event", "e.data")


def parse_events(streams: DataFrame) -> DataFrame:
    """(stream_id, n, event, data) of streams (stream_id, text). Blocks end with a blank line; a last one without it is
    incomplete and left out. Data lines of a block are joined by line breaks, and blocks without data are left out."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    blocks = F.split(text, "\n\n")
    whole = streams.select("stream_id", F.posexplode(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("n", "block"))
    lines = F.split("block", "\n")
    of = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(f"{field}:")), lambda x: F.regexp_replace(x, f"^{field}: ?", ""))
    found = whole.select("stream_id", "n", F.coalesce(F.get(of("event"), 0), F.lit("message")).alias("event"), of("data").alias("_data"))
    return found.filter(F.size("_data") > 0).select("stream_id", "n", "event", F.array_join("_data", "\n").alias("data"))


def completion_text(events: DataFrame) -> DataFrame:
    """(stream_id, text, usage) of a provider's stream (stream_id, n, data): the delta contents before [DONE], in order, and
    the last usage in it. text is null where it is longer than MAX_COMPLETION characters, which is refused."""
    done = events.filter("data = '[DONE]'").groupBy("stream_id").agg(F.min("n").alias("_end"))
    kept = events.join(done, "stream_id", "left").filter(F.col("_end").isNull() | (F.col("n") < F.col("_end")))
    part = F.get_json_object("data", "$.choices[0].delta.content")
    joined = F.sort_array(F.collect_list(F.when(part.isNotNull(), F.struct("n", part.alias("part")))))
    usage = F.max_by(F.when(F.get_json_object("data", "$.usage").isNotNull(), usage_of(F.col("data"))), F.when(F.get_json_object("data", "$.usage").isNotNull(), F.col("n")))
    found = kept.groupBy("stream_id").agg(F.array_join(F.transform(joined, lambda x: x["part"]), "").alias("text"), usage.alias("usage"))
    return found.withColumn("text", F.when(F.char_length("text") <= MAX_COMPLETION, F.col("text")))
