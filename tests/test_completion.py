"""Uploads put together from their parts, and the sweep of files that nothing refers to."""

from __future__ import annotations

import hashlib
import io
import random
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

from lodestone.config import Settings
from lodestone.operators.completion import complete_uploads
from lodestone.session import new_path
from lodestone.sources import assembly, sink

FILES = "file_id long, suffix string, total_bytes long, declared_sha256 string"
PARTS = "file_id long, offset_bytes long, sent int, content binary"
AS_OF = "2024-01-20 00:00:00"
SESSIONS = "upload_id long, knowledge_base_id string, original_name string, declared_sha256 string, total_bytes long, received_bytes long, status string, expires_at string"


def cut(file_id, content, step, sent=1):
    return [(file_id, at, sent, content[at : at + step]) for at in range(0, len(content), step)]


def docx(members=("[Content_Types].xml", "word/document.xml")):
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as archive:
        for name in members:
            archive.writestr(name, "<x/>")
    return file.getvalue()


def made(spark, contents, parts):
    """What comes of files {id: (suffix, content)} and parts, and the path."""
    path = new_path(spark, "assembly")
    rows = [(k, s, len(c), hashlib.sha256(c).hexdigest()) for k, (s, c) in contents.items()]
    found = assembly.assemble(spark.createDataFrame(rows, FILES), spark.createDataFrame(parts, PARTS), path)
    return {r.file_id: r for r in found.collect()}, path


def test_parts_in_any_order_make_the_whole(spark):
    wide = "naïve – größer 𝄞 ".encode() * 50
    contents = {1: (".txt", wide), 2: (".docx", docx()), 3: (".pdf", b"%PDF-1.7 x"), 4: (".md", wide)}
    parts = [p for k, (_, c) in contents.items() for p in cut(k, c, 3)]  # characters lie across parts
    parts += [(4, 0, 0, b"old"), (4, 3, 0, b"\xff\xff\xff"), (4, None, 1, b"lost")]
    random.Random(1).shuffle(parts)
    found, path = made(spark, contents, parts)
    assert {k: r.error for k, r in found.items()} == dict.fromkeys(contents)
    read = {r.storage_key: bytes(r.content) for r in sink.stored_content(spark, path).collect()}
    assert all(read[found[k].storage_key] == c for k, (_, c) in contents.items())
    assert {r.storage_key for r in assembly.files_there(spark, path).collect()} == set(read)
    keys = spark.createDataFrame([(k,) for k in [*read, *read, "gone/aa/aa", None]], "storage_key string")
    hashed = {r.storage_key: (r.size_bytes, r.sha256) for r in assembly.hash_files(keys, path).collect()}
    assert hashed == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in read.items()} | {"gone/aa/aa": (None, None)}


def test_what_is_wrong_leaves_nothing(spark):
    text = b"0123456789" * 3
    contents = {1: (".txt", text), 2: (".txt", text), 3: (".txt", text), 4: (".txt", b"a\x00b\xff"), 5: (".txt", b"ab\xff"), 6: (".txt", "é".encode()[:1]), 7: (".docx", b"PK"), 8: (".docx", docx(["word/document.xml"])), 9: (".pdf", b"%PDF"), 10: (".txt", text), 11: (".txt", b"none")}
    parts = [p for k, (_, c) in contents.items() if k not in (1, 2, 3, 10, 11) for p in cut(k, c, 2)]
    parts += [cut(1, text, 10)[i] for i in (0, 2)]  # a gap
    parts += [(2, 0, 1, text[:12]), (2, 10, 1, text[10:])]  # an overlap
    parts += [*cut(3, text, 10), (3, 30, 1, b"more")]
    parts += [(10, 0, 1, None), *cut(10, text, 10)[1:]]
    parts += [(99, 0, 1, b"of no file")]
    found, path = made(spark, contents, parts)
    other = "other content"
    assert {k: r.error for k, r in found.items()} == {1: other, 2: other, 3: None, 4: "binary data", 5: "not UTF-8", 6: "not UTF-8", 7: "not a DOCX", 8: "not a DOCX", 9: "not a PDF", 10: other}
    assert assembly.files_there(spark, path).count() == 1


def test_against_a_plain_fold(spark):
    draw = random.Random(7)
    contents, parts = {}, []
    for k in range(60):
        body = bytes(draw.choices(b"abc", k=draw.randrange(1, 40)))
        contents[k] = (".txt", body)
        whole = cut(k, body, draw.randrange(1, 9))
        for p in whole:
            if draw.random() < 0.9:
                parts.append(p)
            if draw.random() < 0.2:
                parts.append((k, p[1], draw.choice((0, 2)), bytes(draw.choices(b"abc", k=len(p[3])))))

    def fold(k):
        held = {}
        for _, at, sent, content in sorted((p for p in parts if p[0] == k), key=lambda p: (p[1], p[2], p[3])):
            held[at] = content
        out = b""
        for at in sorted(held):
            if at != len(out):
                break
            out += held[at]
        return out

    found, _ = made(spark, contents, parts)
    assert set(found) == {p[0] for p in parts}
    assert {k: r.error is None for k, r in found.items()} == {k: fold(k) == contents[k][1] for k in found}


def test_completion_comes_to_every_outcome(spark):
    text = {k: f"text {k}".encode() for k in range(1, 14)}
    text[10] = text[9]
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in text.items()}
    later, over = "2024-01-20 01:00:00", AS_OF
    row = lambda k, name="a.txt", got=None, status="open", until=later: (k, "kb", name, sha[k].upper() if k == 9 else sha[k], len(text[k]), len(text[k]) if got is None else got, status, until)
    rows = [row(1, status="completed"), row(2, status="failed"), row(3, until=over), row(4, got=3), row(5), row(6), row(7, "a.pdf"), row(8), row(9, "dir/b.md"), row(10), row(11), row(12), row(13, "a.html")]
    sessions = spark.createDataFrame(rows, SESSIONS)
    sessions = sessions.withColumn("expires_at", sessions.expires_at.cast("timestamp"))
    parts = [p for k, v in text.items() if k != 5 for p in cut(k, v if k != 6 else b"wrong 6"[: len(v)], 4)]
    parts = spark.createDataFrame(parts, PARTS).withColumnRenamed("file_id", "upload_id")
    docs = spark.createDataFrame([("kb", sha[8]), ("other", sha[9]), (None, None)], "knowledge_base_id string, sha256 string")
    path = new_path(spark, "completion")
    states, new = complete_uploads(sessions, parts, docs, path, AS_OF, Settings(max_documents=5))
    got = {r.upload_id: r for r in states.collect()}
    want = ["completed before", "not open", "expired", "incomplete", "no file", "other content", "not a PDF", "duplicate document", "completed", "duplicate document", "completed", "capacity", "suffix"]
    assert [got[k].outcome for k in range(1, 14)] == want
    assert [got[k].status for k in range(1, 14)] == ["completed", "failed", "open", "open", *["failed"] * 4, "completed", "failed", "completed", "failed", "failed"]
    assert {k for k in got if got[k].expires_at == datetime(2024, 1, 21)} == set(range(5, 14))
    found = {r.document_id: r for r in new.collect()}
    assert set(found) == {got[9].document_id, got[11].document_id} == {r.document_id for r in got.values()} - {None}
    ninth = found[got[9].document_id]
    assert (ninth.original_name, ninth.media_type, ninth.size_bytes, ninth.sha256, ninth.status) == ("b.md", "text/markdown", 6, sha[9], "pending")
    full = complete_uploads(sessions, parts, docs, new_path(spark, "completion"), AS_OF, Settings(max_documents=3))
    assert full[1].count() == 0 and full[0].filter("outcome = 'capacity'").count() == 5

    later = datetime.now() + timedelta(hours=1)
    assert assembly.sweep_files(spark, path, new, datetime.now() - timedelta(minutes=5)).count() == 0  # all are young
    gone = assembly.sweep_files(spark, path, new, later)
    assert gone.count() > 0 and assembly.sweep_files(spark, path, new, later).count() == 0
    assert {r.storage_key for r in assembly.files_there(spark, path).collect()} == {r.storage_key for r in found.values()}
    assert {hashlib.sha256(r.content).hexdigest() for r in sink.stored_content(spark, path).collect()} == {sha[9], sha[11]}


def test_sweeps_remove_what_lost_writes_left(spark):
    found, path = made(spark, {1: (".txt", b"one")}, [(1, 0, 1, b"one")])
    lost = Path(path.removeprefix("file://")) / "_temporary" / "run" / "task"
    lost.mkdir(parents=True)
    (lost / "x.part").write_bytes(b"half")
    marked, later = spark.createDataFrame([(found[1].storage_key,), (None,)], "storage_key string"), datetime.now() + timedelta(hours=1)
    assert assembly.sweep_files(spark, path, marked, later).count() == 0 and (lost / "x.part").exists()
    assert [r.size_bytes for r in assembly.sweep_files(spark, path, marked, later, later).collect()] == [4]
    assert not (lost / "x.part").exists() and assembly.files_there(spark, path).count() == 1


def test_empty_tables(spark):
    found, path = made(spark, {}, [])
    assert found == {} and assembly.files_there(spark, path).count() == 0
    nothing = spark.createDataFrame([], "storage_key string")
    assert assembly.sweep_files(spark, path, nothing, datetime.now()).count() == 0
