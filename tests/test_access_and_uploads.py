"""Access, uploads and settings on small tables."""

from __future__ import annotations

import pytest

from lodestone.config import Settings
from lodestone.operators import access, conversations, uploads


def test_settings_have_ranges():
    with pytest.raises(ValueError):
        Settings(rrf_k=0)
    with pytest.raises(ValueError):
        Settings(chunk_target_characters=500, chunk_overlap_characters=500)


def test_the_last_administrator_stays(spark):
    users = spark.createDataFrame([(1, True, True, 1), (2, True, False, 1), (3, False, True, 4)], "user_id int, is_enabled boolean, is_administrator boolean, session_version int")
    change = lambda *rows: {r.user_id: r for r in access.change_users(users, spark.createDataFrame(list(rows), "user_id int, is_enabled boolean, is_administrator boolean")).collect()}
    got = change((1, False, None))
    assert got[1].outcome == "last administrator" and got[1].is_enabled and got[1].session_version == 1
    got = change((1, None, False), (2, None, True))
    assert (got[1].outcome, got[1].session_version, got[2].session_version) == ("changed", 2, 2)
    assert change((3, True, None))[3].session_version == 4


def test_grants(spark):
    users = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, True)], "user_id int, is_enabled boolean, is_administrator boolean")
    kbs = spark.createDataFrame([("a",), ("b",)], "knowledge_base_id string")
    given = spark.createDataFrame([(1, "a"), (1, "gone"), (3, "a")], "user_id int, knowledge_base_id string")
    assert sorted(map(tuple, access.accessible(users, kbs, given).collect())) == [(1, "a"), (2, "a"), (2, "b")]


def test_new_rows_go_in_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    there = spark.createDataFrame([(2, "x")], "k int, v string")
    assert [r.k for r in access.insert_new(rows, there, ["k"]).collect()] == [1]
    assert [(r.k, r.n) for r in access.violations(rows, ["k"]).collect()] == [(1, 2)]


def test_parts(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1 << 20), (3, (1 << 20) * 2 + 5)], "upload_id int, total_bytes long")
    got = uploads.plan_parts(rows, Settings(upload_part_bytes=1 << 20)).orderBy("upload_id", "offset_bytes").collect()
    assert [tuple(r) for r in got] == [(2, 0, 1 << 20), (3, 0, 1 << 20), (3, 1 << 20, 1 << 20), (3, 2 << 20, 5)]
    parts = spark.createDataFrame([(1, 0, 5), (1, 5, 5), (1, 11, 5)], "upload_id int, offset_bytes long, length_bytes int")
    assert [r.in_order for r in uploads.audit_offsets(parts).orderBy("offset_bytes").collect()] == [True, True, False]


def test_history_and_turns(spark):
    rows = [(i, 1, i, "user" if i % 2 else "assistant", "failed" if i == 2 else "complete", str(i), "2024-01-01 00:00:00") for i in range(1, 14)]
    rows.append((14, 1, 14, "assistant", "streaming", "", "2024-01-01 00:00:00"))
    frame = spark.createDataFrame(rows, "id int, conversation_id int, sequence int, role string, status string, content string, created_at string")
    frame = frame.withColumn("created_at", frame.created_at.cast("timestamp"))
    got = {r.sequence: [h.content for h in r.history] for r in conversations.with_history(frame).collect()}
    assert got[1] == [] and got[3] == ["1"] and got[13] == [str(i) for i in range(5, 13)]
    owned = spark.createDataFrame([(1, "New Conversation")], "conversation_id int, title string")
    asked = spark.createDataFrame([(1, "Why?")], "conversation_id int, question string")
    busy = conversations.create_turns(owned, frame, asked, "2024-01-01 00:10:00").first()
    free = conversations.create_turns(owned, frame, asked, "2024-01-01 00:20:00").first()
    assert (busy.outcome, busy.title) == ("busy", "New Conversation")
    assert tuple(free) == (1, "created", 15, 16, 14, "Why?")


def test_admission_comes_to_every_outcome(spark):
    asked = [(1, "a.html", "x", 1), (2, "a.txt", "x", 99 << 20), (3, "a.txt", "there", 5), (4, "a.pdf", "open", 7), (5, "a.pdf", "open", 8), (6, "a.md", "new", 5), (7, "b.md", "new", 5), (8, "c.md", "newer", 5)]
    requests = spark.createDataFrame([(i, "k", n, s, b) for i, n, s, b in asked], "request_id long, knowledge_base_id string, original_name string, sha256 string, size_bytes long")
    docs = spark.createDataFrame([("k", "there")], "knowledge_base_id string, sha256 string")
    sessions = spark.createDataFrame([("k", "open", 7, "open"), ("k", "new", 5, "completed")], "knowledge_base_id string, declared_sha256 string, total_bytes long, status string")
    found = uploads.create_sessions(requests, docs, sessions, Settings(max_active_upload_sessions=2)).collect()
    want = ["format", "too large", "duplicate document", "resumed", "other file", "created", "capacity", "capacity"]
    assert [r.outcome for r in sorted(found, key=lambda r: r.request_id)] == want


def test_admission_is_judged_against_all_uploads(spark):
    from lodestone.plans import QUERIES

    tally = lambda name: {r.outcome: r["count"] for r in QUERIES[name](spark, "/root/testdata/sf0.1").groupBy("outcome").count().collect()}
    few, full = tally("upload_admission"), tally("upload_admission_full")
    assert full["other file"] > 4 * few["other file"] and full["capacity"] < few["capacity"] / 4


@pytest.mark.parametrize("name", ["upload_admission", "upload_admission_full", "upload_admission_at"])
def test_admission_of_a_size_above_an_integer(spark, data, tmp_path, name):
    import duckdb

    from lodestone.plans import ORACLES, QUERIES

    db = duckdb.connect()
    for table in ("orders", "documents", "pages"):
        long = " UNION ALL SELECT max(page_id) + 2, 'http://long', repeat('x', 200000) FROM pages" if table == "pages" else ""
        db.sql(f"CREATE TABLE {table} AS FROM '{data}/{table}.parquet'")
        db.sql(f"COPY (FROM {table}{long}) TO '{tmp_path}/{table}.parquet'")
        db.sql(f"CREATE OR REPLACE TABLE {table} AS FROM '{tmp_path}/{table}.parquet'")
    wanted = db.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*wanted.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted.fetchall()))
    assert "too large" in {r.outcome for r in got}
