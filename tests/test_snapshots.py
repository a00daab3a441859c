"""Snapshots: batches, versions, conflicts, compaction and sweeping."""

from __future__ import annotations

import pytest

from lodestone.operators import snapshots
from lodestone.session import new_path

CHUNKS, STATES = "document_id long, ordinal int, text string", "document_id long, status string"


def put(spark, path, rows, states, **more):
    return snapshots.publish(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(states, STATES), path, **more)


def at(spark, path, version=None):
    return sorted((r.document_id, r.ordinal, r.text) for r in snapshots.snapshot(spark, path, version).collect())


def three(spark):
    path = new_path(spark, "snapshots")
    put(spark, path, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (None, 0, "x")], [(1, "ready"), (2, "ready"), (3, "ready"), (None, "ready")])
    put(spark, path, [(1, 0, "new"), (2, 0, "of one that failed"), (4, 0, "e"), (9, 0, "not in the batch")], [(1, "ready"), (2, "failed"), (4, "ready")])
    put(spark, path, [(2, 0, "back"), (3, 0, "d")], [(2, "ready"), (3, "ready"), (4, "ready"), (5, "ready")])
    return path


LAST = [(1, 0, "new"), (2, 0, "back"), (3, 0, "d")]


def test_each_version_stays_as_it_was(spark):
    path = three(spark)
    assert at(spark, path, 1) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")]
    assert at(spark, path, 2) == [(1, 0, "new"), (3, 0, "d"), (4, 0, "e")]
    assert at(spark, path) == at(spark, path, 3) == LAST
    found = {r.document_id: (r.n_before, r.n_after, r.change) for r in snapshots.changes(spark, path, 1, 3).collect()}
    assert found == {1: (2, 1, "replaced"), 2: (1, 1, "replaced"), 3: (1, 1, "same"), 4: (0, 0, "none"), 5: (0, 0, "none")}
    assert {r.document_id: r.change for r in snapshots.changes(spark, path, 1, 2).collect()} == {1: "replaced", 2: "removed", 4: "added"}
    assert snapshots.changes(spark, path, 3, 3).count() == 0
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, path, 7)


def test_a_failed_batch_leaves_the_snapshot(spark):
    path = three(spark)
    bad = spark.sql("SELECT 1L AS document_id, CAST(id AS INT) AS ordinal, CASE WHEN id > 5 THEN raise_error('lost') ELSE 'z' END AS text FROM range(10)")
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(bad, spark.createDataFrame([(1, "ready")], STATES), path)
    assert at(spark, path) == LAST and snapshots.versions(spark, path) == [1, 2, 3]


def test_the_manifest_is_exchanged_by_comparing(spark):
    path = three(spark)
    with pytest.raises(snapshots.Conflict):
        put(spark, path, [(7, 0, "late")], [(7, "ready")], expected=2)
    assert put(spark, path, [(7, 0, "in time")], [(7, "ready")], expected=3) == 4
    assert not snapshots.Folder(spark, path).create("log/000000000004.json", "{}")
    assert at(spark, path) == [*LAST, (7, 0, "in time")]


def test_a_writer_that_comes_second_goes_after_the_first(spark, monkeypatch):
    path = three(spark)
    create, raced = snapshots.Folder.create, []

    def slower(self, name, text):
        if not raced:
            raced.append(name)
            put(spark, path, [(1, 0, "first"), (6, 0, "first")], [(1, "ready"), (6, "ready")])
        return create(self, name, text)

    monkeypatch.setattr(snapshots.Folder, "create", slower)
    assert put(spark, path, [(1, 0, "second")], [(1, "ready")]) == 5
    assert at(spark, path) == [(1, 0, "second"), *LAST[1:], (6, 0, "first")]


def test_compaction_keeps_what_comes_meanwhile(spark, monkeypatch):
    path = three(spark)
    create, raced = snapshots.Folder.create, []

    def slower(self, name, text):
        if not raced:
            raced.append(name)
            put(spark, path, [(3, 0, "meanwhile")], [(3, "ready")])
        return create(self, name, text)

    monkeypatch.setattr(snapshots.Folder, "create", slower)
    version = snapshots.compact(spark, path)
    monkeypatch.undo()
    assert version == 5 and len(snapshots.manifest(spark, path).deltas) == 2
    assert at(spark, path) == [*LAST[:2], (3, 0, "meanwhile")] and at(spark, path, 2) == [(1, 0, "new"), (3, 0, "d"), (4, 0, "e")]
    assert {r.document_id: r.change for r in snapshots.changes(spark, path, 3, 5).collect()} == {3: "replaced"}


def test_a_sweep_keeps_what_kept_versions_need(spark):
    path = three(spark)
    orphan = spark.createDataFrame([(1,)], "x int")
    orphan.write.parquet(f"{path}/data/{'0' * 32}/chunks")
    assert snapshots.sweep(spark, path, keep=1) == []  # nothing is old enough
    snapshots.compact(spark, path)
    gone = snapshots.sweep(spark, path, keep=1, older_than_ms=0)
    assert len(gone) == 7 and f"data/{'0' * 32}" in gone  # three versions, three deltas, one that no version names
    assert snapshots.sweep(spark, path, keep=1, older_than_ms=0) == [] and at(spark, path) == LAST
    put(spark, path, [(8, 0, "after")], [(8, "ready")])
    assert at(spark, path) == [*LAST, (8, 0, "after")]


def test_a_batch_writes_itself_alone(spark):
    path = new_path(spark, "snapshots")
    many = spark.range(3000).selectExpr("id AS document_id", "0 AS ordinal", "repeat('x', 50) AS text")
    snapshots.publish(many, many.selectExpr("document_id", "'ready' AS status"), path)
    put(spark, path, [(1, 0, "new")], [(1, "ready")])
    last = snapshots.manifest(spark, path).deltas[-1].name
    assert spark.read.parquet(f"{path}/data/{last}/chunks").count() == 1 and snapshots.snapshot(spark, path).count() == 3000
