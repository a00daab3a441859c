"""Answers against their evidence."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import delivery, grounding


def answer(status, *claims):
    return json.dumps({"status": status, "claims": [{"text": t, "evidence_ids": i} for t, i in claims]})


def ground(spark, *texts, repair=None):
    rows = [(n, t, ["E1", "E2"], repair, {"prompt_tokens": 1}, {"prompt_tokens": 2, "total_tokens": 5}) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "turn_id int, text string, evidence_ids array<string>, repair_text string, usage map<string,int>, repair_usage map<string,int>")
    return grounding.ground(frame).orderBy("turn_id").collect()


def test_numbers_go_by_first_use(spark):
    (r,) = ground(spark, answer("answer", (" One. ", ["E2"]), ("Two.", ["E1", "E2"])))
    assert (r.outcome, r.content, r.used) == ("grounded_answer", "One. [1]\n\nTwo. [2] [1]", ["E2", "E1"])


def test_conflicts_need_two_sides(spark):
    a, b = ground(spark, answer("conflicting", ("x", ["E1"]), ("y", ["E1"])), answer("conflicting", ("x", ["E1"]), ("y", ["E2"])))
    assert a.rejected == "one-sided conflict" and a.outcome == "validation_rejected"
    assert b.content == f"{grounding.CONFLICT}\n\n- x [1]\n\n- y [2]"


def test_rejections(spark):
    texts = [answer("answer", ("see [e1]", ["E1"])), answer("answer", ("x", ["E7"])), answer("maybe"), answer("answer"), answer("insufficient", ("x", ["E1"])), "no json", None, answer("answer", ("x", [])), answer("answer", ("", ["E1"])), answer("answer", *[("x", ["E1"])] * 13)]
    assert [r.rejected for r in ground(spark, *texts)] == ["own marker", "unknown evidence"] + ["format"] * 8


def test_an_insufficient_answer_is_one(spark):
    (r,) = ground(spark, "<think>{a}</think>```" + answer("insufficient") + "```")
    assert (r.outcome, r.content, r.used) == ("insufficient_evidence", grounding.INSUFFICIENT, [])


def test_repairs(spark):
    (good,) = ground(spark, "bad", repair=answer("answer", ("x", ["E1"])))
    (bad,) = ground(spark, "bad", repair="also bad")
    assert (good.content, good.usage) == ("x [1]", {"prompt_tokens": 3, "total_tokens": 5})
    assert (bad.content, bad.usage) == (grounding.UNVERIFIABLE, {"prompt_tokens": 1})


def test_events_round_trip(spark):
    data = [(1, 7, "grounded_answer", True, "é" * 250, [(1, "a")]), (2, 8, "generation_failed", True, delivery.FAILED, []), (3, 9, "insufficient_evidence", False, "n" * 200, []), (4, 9, "insufficient_evidence", True, "", [])]
    rows = spark.createDataFrame(data, "turn_id int, message_id int, outcome string, generated boolean, content string, citations array<struct<n: int, document: string>>")
    events = delivery.turn_events(rows)
    by = {t: [r.event for r in events.filter(F.col("turn_id") == t).orderBy("n").collect()] for t in (1, 2, 3, 4)}
    stages = ["status"] * 3
    assert by == {1: [*stages, "start", "delta", "delta", "delta", "citations", "done"], 2: ["status", "status", "error"], 3: ["status", "start", "delta", "citations", "done"], 4: [*stages, "start", "citations", "done"]}
    first = {r.event: json.loads(r.data) for r in events.filter("turn_id = 1").orderBy("n").collect()}
    assert first["start"] == {"message_id": "7", "status": "complete"} and first["citations"] == {"items": [{"n": 1, "document": "a"}]} and first["done"] == {"outcome": "grounded_answer"}
    framed = events.orderBy("turn_id", "n").select(delivery.frame(F.col("event"), F.col("data")).alias("f")).collect()
    stream = spark.createDataFrame([(1, "".join(r.f for r in framed) + "event: cut\ndata: {}")], "stream_id int, text string")
    assert delivery.parse_events(stream).count() == events.count()


def test_provider_stream(spark):
    part = lambda c: json.dumps({"choices": [{"delta": {"content": c}}]})
    rows = [(1, 0, part("a")), (1, 1, json.dumps({"choices": [{"delta": {"reasoning": "x"}}]})), (1, 2, part("b")), (1, 3, "[DONE]"), (1, 4, part("c")), (2, 0, part("d"))]
    got = delivery.completion_text(spark.createDataFrame(rows, "stream_id int, n int, data string")).collect()
    assert {r.stream_id: r.text for r in got} == {1: "ab", 2: "d"}


def test_a_completion_that_is_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(delivery, "MAX_COMPLETION", 3)
    part = lambda c: json.dumps({"choices": [{"delta": {"content": c}}], "usage": {"prompt_tokens": len(c)}})
    rows = [(1, 0, part("ab")), (1, 1, part("c")), (2, 0, part("abcd"))]
    got = {r.stream_id: (r.text, r.usage) for r in delivery.completion_text(spark.createDataFrame(rows, "stream_id int, n int, data string")).collect()}
    assert got == {1: ("abc", {"prompt_tokens": 1}), 2: (None, {"prompt_tokens": 4})}


def test_the_first_words_are_those_of_the_whole_text(spark):
    """Words are taken from as much of a text as has them, with the same result as from all of it."""
    import random

    from pyspark.sql import functions as F

    from lodestone.plans.conversation_queries import BEGINNING

    random.seed(4)
    texts = ["", "\n", "12 34", "\n a b c d e f g h", " \n\n1 a\tb 2c\n\n3 d é f.g h i j k", "a" * 9000 + " b", *("".join(random.choices("ab1. \n\té中 ", k=random.randint(1, 60))) for _ in range(400))]
    cut = lambda c: F.slice(F.split(F.trim(F.regexp_replace(c, r"[^\p{L}\n ]", "")), r"\s+"), 1, 6)
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    part = F.regexp_extract("text", BEGINNING, 0)
    assert rows.filter(~cut(F.col("text")).eqNullSafe(cut(part))).count() == 0
    assert spark.createDataFrame([("word " * 100_000,)], "text string").select(F.char_length(part)).first()[0] < 100


def test_words_and_answers_are_evaluated_once(spark, data):
    from lodestone.plans.conversation_queries import marker_split

    plan = marker_split(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<think>{not this}") == 1 and plan.count("from_json(") + plan.count("jsontostructs(") <= 2
