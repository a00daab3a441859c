"""The sink of whole files."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.session import new_path
from lodestone.sources import sink

SCHEMA = "file_id long, name string, content binary"


def there(path):
    return sorted(str(p.relative_to(Path(path.removeprefix("file://")))) for p in Path(path.removeprefix("file://")).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_files_are_kept_by_digest_and_others_leave_nothing(spark):
    path = new_path(spark, "stored")
    long = b"x" * (3 * sink.STEP + 5)
    rows = [(1, "a.txt", b"one"), (2, "dir/b.md", b"one"), (3, "c.txt", long), (4, "d.txt", b""), (5, "e.txt", None), (6, "f.html", b"<p>"), (7, "g.pdf", b"no"), (8, "h.txt", b"\xff\xfe"), (9, "i.txt", b"exactly ten"[:10])]
    found = {r.file_id: r for r in sink.store_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, 10).collect()}
    assert {k: r.error for k, r in found.items()} == {1: None, 2: None, 3: "too large", 4: "empty", 5: "empty", 6: "suffix", 7: "not a PDF", 8: "not UTF-8", 9: None}
    digest = hashlib.sha256(b"one").hexdigest()
    assert found[1].sha256 == digest and found[1].storage_key == found[2].storage_key and found[1].storage_key.endswith(f"/{digest[:2]}/{digest}")
    assert (found[2].original_name, found[9].size_bytes, found[3].size_bytes) == ("b.md", 10, None)
    assert {bytes(r.content) for r in sink.stored_content(spark, path).collect()} == {b"one", b"exactly te"}
    assert len(there(path)) == 3  # two contents and an index
    kept = there(path)
    assert sink.store_files(spark.createDataFrame([(3, "c.txt", long)], SCHEMA), path, 10).first().error == "too large"
    assert set(kept) < set(there(path)) and sink.stored_content(spark, path).count() == 2


def test_a_long_file_is_written_in_pieces(spark):
    path, long = new_path(spark, "stored"), bytes(range(1, 128)) * (2 * sink.STEP // 100)
    row = sink.store_files(spark.createDataFrame([(1, "a.txt", long)], SCHEMA), path).first()
    assert (row.size_bytes, row.sha256, row.error) == (len(long), hashlib.sha256(long).hexdigest(), None)


def test_a_failed_write_leaves_nothing(spark):
    path = new_path(spark, "stored")
    spark.dataSource.register(sink.StoredFiles)
    bad = spark.range(200).select(F.col("id").alias("file_id"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).alias("content")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("stored_files").mode("append").option("path", path).option("max_bytes", 100).save()
    assert there(path) == []
    with pytest.raises(Exception, match="never overwritten"):
        spark.createDataFrame([(1, b"x")], "file_id long, content binary").write.format("stored_files").mode("overwrite").option("path", path).option("max_bytes", 100).save()


def test_an_empty_table(spark):
    path = new_path(spark, "stored")
    assert sink.store_files(spark.createDataFrame([], SCHEMA), path).count() == 0 and there(path) == []
    refused = sink.store_files(spark.createDataFrame([(1, "a.html", b"x")], SCHEMA), path)
    assert refused.first().error == "suffix" and sink.stored_content(spark, path).count() == 0


def test_the_driver_lists_no_stored_file(spark):
    path = new_path(spark, "stored")
    sink.store_files(spark.createDataFrame([(n, f"{n}.txt", b"%d" % n) for n in range(50)], SCHEMA).coalesce(2), path)
    back = sink.stored_content(spark, path)
    assert {bytes(r.content) for r in back.collect()} == {b"%d" % n for n in range(50)}
    assert all(f.endswith("/index.parquet") for f in back.inputFiles())
