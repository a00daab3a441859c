"""Publishing, sessions, responses and edits on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.config import Settings
from lodestone.operators import access, embedding, lifecycle, uploads

CHUNKS = "document_id long, ordinal int, text string"


def test_publishing_one_document_leaves_the_others(spark):
    path = session.new_path(spark, "one")
    many = spark.range(600).select(F.col("id").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("old").alias("text"))
    ready = many.select("document_id", F.lit("ready").alias("status"))
    assert lifecycle.publish_chunks(many, ready, path, 16).count() == 600
    one = spark.createDataFrame([(1, 0, "new"), (1, 1, "more"), (2, 0, "of one that failed")], CHUNKS)
    states = spark.createDataFrame([(1, "ready"), (2, "failed"), (3, "ready"), (999, "ready")], "document_id long, status string")
    got = lifecycle.publish_chunks(one, states, path, 16)
    assert got.columns == ["document_id", "ordinal", "text"] and got.count() == 599
    assert sorted((r.ordinal, r.text) for r in got.filter("document_id < 4 AND document_id > 0").collect()) == [(0, "new"), (1, "more")]


def test_a_folder_that_loses_all_its_chunks(spark):
    path = session.new_path(spark, "last")
    rows, state = spark.createDataFrame([(1, 0, "x")], CHUNKS), "document_id long, status string"
    lifecycle.publish_chunks(rows, spark.createDataFrame([(1, "ready")], state), path, 4)
    assert lifecycle.publish_chunks(rows, spark.createDataFrame([(1, "failed")], state), path, 4).count() == 0


def test_each_chunk_needs_one_vector(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], CHUNKS)
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [3.0]), (2, 1, [4.0])], "document_id long, ordinal int, embedding array<float>")
    whole, errors = lifecycle.with_vectors(chunks, vectors)
    assert whole.count() == 2 and {r.document_id for r in errors.collect()} == {2, 3}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ('{"output":{"embeddings":[{"index":1,"embedding":[3,4]},{"index":0,"embedding":[1,2]}]}}', None),
        ('{"output":{"embeddings":[{"index":0,"embedding":[1,2]}]}}', "count"),
        ('{"output":{"embeddings":[{"index":0,"embedding":[1,2]},{"index":0,"embedding":[1,2]}]}}', "index"),
        ('{"output":{"embeddings":[{"index":0,"embedding":[1,2]},{"index":1,"embedding":[1]}]}}', "dimension"),
        ('{"output":{"embeddings":[{"index":0,"embedding":[1,2]},{"index":1,"embedding":[1,null]}]}}', "not finite"),
        ("{}", "format"), ("no", "format"), (None, "format"),
    ],
)
def test_embedding_responses(spark, body, error):
    rows = spark.createDataFrame([(1, 2, body)], "request_id int, n_texts int, body string")
    judged, vectors = embedding.read_responses(rows, Settings(embedding_dimension=2))
    assert judged.first().error == error
    assert [r.embedding for r in vectors.orderBy("position").collect()] == ([[1.0, 2.0], [3.0, 4.0]] if error is None else [])


def test_parts_in_turn(spark):
    digest = lambda x: x * 64
    sessions = spark.createDataFrame([(1, 25, 10, 0, "open", "2030-01-01"), (2, 5, 10, 0, "completed", "2030-01-01")], "upload_id int, total_bytes long, part_bytes int, received_bytes long, status string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    receipts = sessions.limit(0).select("upload_id", F.lit(0).alias("offset_bytes"), F.lit(0).alias("length_bytes"), F.lit("").alias("sha256"))
    sent = [(0, 10, "a", 10, "a"), (0, 10, "a", 10, "a"), (0, 10, "b", 10, "b"), (10, 9, "c", 9, "c"), (10, 10, "C", 10, "c"), (20, 5, "d", 4, "d"), (20, 5, "d", 5, "e"), (20, 5, "d", 5, "d")]
    rows = [(1, n, o, k, digest(x), m, digest(y)) for n, (o, k, x, m, y) in enumerate(sent)] + [(2, 0, 0, 5, digest("a"), 5, digest("a")), (3, 0, 0, 5, digest("a"), 5, digest("a"))]
    parts = spark.createDataFrame(rows, "upload_id int, sent int, offset_bytes long, length_bytes long, sha256 string, content_bytes long, content_sha256 string")
    got = uploads.put_parts(sessions, receipts, parts, "2024-01-01").orderBy("upload_id", "sent").collect()
    assert [r.outcome for r in got] == ["stored", "confirmed again", "other bytes", "wrong length", "stored", "wrong length", "checksum mismatch", "stored", "not open", "unknown upload"]
    assert [r.next_offset for r in got[:8]] == [10, 10, 10, 10, 20, 20, 20, 25]


def test_receipts_and_parts_that_are_dealt_by_upload_already(spark):
    digest = F.lit("a" * 64)
    ids = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("upload_id"))
    until = F.lit("2030-01-01").cast("timestamp")
    sessions = ids.select("upload_id", F.lit(10).alias("total_bytes"), F.lit(10).alias("part_bytes"), F.lit(10).alias("received_bytes"), F.lit("open").alias("status"), until.alias("expires_at"))
    receipts = ids.groupBy("upload_id").agg(F.lit(0).alias("offset_bytes"), F.lit(10).alias("length_bytes"), digest.alias("sha256"))
    lines = ids.select("upload_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("sent")).groupBy("upload_id", "sent").count().repartition("upload_id")
    parts = lines.select("upload_id", "sent", F.lit(0).alias("offset_bytes"), F.lit(10).alias("length_bytes"), digest.alias("sha256"), F.lit(10).alias("content_bytes"), digest.alias("content_sha256"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        said = uploads.put_parts(sessions, receipts, parts, "2024-01-01").groupBy("outcome").count().collect()
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.parallelismFirst", "adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.{name}")
    assert [tuple(r) for r in said] == [("confirmed again", 600_000)]


def test_the_first_administrator(spark):
    users = spark.createDataFrame([(1, "Ann", False), (2, "bob", False)], "user_id int, username string, is_administrator boolean")
    wanted = spark.createDataFrame([(5, "cy"), (4, "ANN")], "user_id int, username string")
    assert access.bootstrap(users, wanted).collect() == []  # the first in line has a name that is taken
    assert [r.user_id for r in access.bootstrap(users, wanted.filter("user_id = 5")).collect()] == [5]
    assert access.bootstrap(users.withColumn("is_administrator", F.lit(True)), wanted).collect() == []
