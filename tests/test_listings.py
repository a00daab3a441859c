"""Places in listings, parts of answers, new conversations."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.operators import conversations, listings


def test_places_in_groups_and_over_all(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", None, "hot", "hot", "hot"]), draw.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, kind string, rank int").repartition(7)
    got = {r.id: r.place for r in listings.placed(frame, [F.desc("rank"), F.col("id")], ["kind"]).collect()}
    want = {}
    for kind in {r[1] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[1] == kind), key=lambda r: (-r[2], r[0])), 1):
            want[row[0]] = place
    assert got == want
    over_all = {r.id: r.place for r in listings.placed(frame, [F.col("rank"), F.col("id")]).collect()}
    assert over_all == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert listings.placed(frame.limit(0), [F.col("id")], ["kind"]).count() == 0
    assert listings.placed(frame.limit(0), [F.col("id")]).count() == 0


def test_no_task_of_a_listing_has_a_whole_group(spark):
    rows = spark.range(4_000).select("id", F.lit("one").alias("kind"))
    found = listings.placed(rows.repartition(4), [F.col("id")], ["kind"])
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert found.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 4_000, 4_000)


def test_places_go_on_from_task_to_task(spark):
    rows = spark.range(4_000).select("id", (F.col("id") % 3).alias("kind")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are sorted in one task else
    try:
        over_all = listings.placed(rows, [F.col("id")])
        wrong = over_all.filter("place <> id + 1").count() + listings.placed(rows, [F.col("id")], ["kind"]).filter("place <> id DIV 3 + 1").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (over_all.count(), wrong) == (4_000, 0)


def test_only_public_columns(spark):
    rows = spark.createDataFrame([(1, "a", False, True, "x", "secret")], "user_id int, username string, is_administrator boolean, is_enabled boolean, created_at string, password_hash string")
    assert listings.list_users(rows).columns == ["place", "user_id", "username", "is_administrator", "is_enabled", "created_at"]
    with pytest.raises(AnalysisException):
        listings.public(rows.drop("username"), "users")


def test_parts_between_markers(spark):
    said = {1: "One [1] and [2].", 2: "[1][2]", 3: "no marker", 4: "", 5: None, 6: "[0] [3] [99999999999999999999] [x] [", 7: "a\n[2]\nb"}
    answers = spark.createDataFrame([(k, v, ["E4", "E7"]) for k, v in said.items()], "turn_id int, content string, used array<string>")
    got = {}
    for r in sorted(conversations.marked_parts(answers).collect()):
        got.setdefault(r.turn_id, []).append((r.part, r.marker, r.evidence_id))
    assert got[1] == [("One ", None, None), ("[1]", 1, "E4"), (" and ", None, None), ("[2]", 2, "E7"), (".", None, None)]
    assert got[2] == [("[1]", 1, "E4"), ("[2]", 2, "E7")] and got[3] == [("no marker", None, None)]
    assert 4 not in got and 5 not in got
    assert "".join(p[0] for p in got[6]) == said[6] and not any(p[2] for p in got[6])
    assert [p[0] for p in got[7]] == ["a\n", "[2]", "\nb"]


def test_payloads_keep_what_is_not_known(spark):
    kind = "citation_id int, document_name string, locator struct<page: int>, excerpt string, retrieval_rank int, retrieval_score double, source_available boolean, source_url string"
    row = conversations.citation_payloads(spark.createDataFrame([(1, 'a "b"', None, "x\ny", 2, None, False, None)], kind)).first()
    assert json.loads(row.payload) == {"id": "1", "document_name": 'a "b"', "locator": None, "excerpt": "x\ny", "retrieval_rank": 2, "retrieval_score": None, "source_available": False, "source_url": None}


def test_conversations_are_created_where_access_is(spark):
    asked = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "b"), (4, 3, "a"), (5, 1, "gone"), (6, 1, None), (7, 1, "a")], "request_id int, owner_id int, knowledge_base_id string")
    bases = spark.createDataFrame([("a",), ("b",), ("b",)], "knowledge_base_id string")
    users = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, True)], "user_id int, is_enabled boolean, is_administrator boolean")
    given = spark.createDataFrame([(1, "a"), (1, "gone"), (2, "b")], "user_id int, knowledge_base_id string")
    found, made = conversations.create_conversations(asked, bases, given, users, "2024-01-01 00:00:00")
    assert {r.request_id: r.outcome for r in found.collect()} == {1: "created", 2: "no access", 3: "created", 4: "no access", 5: "no knowledge base", 6: "no knowledge base", 7: "created"}
    new = made.collect()
    assert len({r.conversation_id for r in new}) == len(new) == 3 and {r.title for r in new} == {"New Conversation"}
