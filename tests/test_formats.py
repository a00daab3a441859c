"""Files and their sections."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lodestone.functions.text import file_size, is_follow_up, progress, safe_name, title
from lodestone.operators.lifecycle import publish_chunks
from lodestone.sources import formats

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def docx(body: str, pages: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", DOC.format(body))
        if pages is not None:
            z.writestr("docProps/app.xml", f"<Properties><Pages>{pages}</Pages></Properties>")
    return out.getvalue()


def para(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx(spark):
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr><w:tr><w:tc>{para('c')}</w:tc></w:tr></w:tbl>"
    files = [(1, docx(para("First") + table + para("") + para("Last"), "2")), (2, docx("")), (3, b"zip?"), (4, docx(para("x"), "900")), (5, docx(para("y"), "many"))]
    got = {r.document_id: r for r in formats.docx_sections(spark.createDataFrame(files, "document_id int, content binary")).collect()}
    assert [(s.section, s.text) for s in got[1].sections] == [("1", "First"), ("2", "a | b\nc"), ("3", "Last")] and got[1].page_count == 2
    assert [got[i].error for i in range(1, 6)] == [None, "no text", "unreadable", "too many pages", None] and got[5].page_count is None


def test_sniffing(spark):
    rows = [(1, b"%PDF-1.7", ".pdf"), (2, b"PDF", ".pdf"), (3, b"ok", ".txt"), (4, b"a\x00", ".md"), (5, b"\xff\xfe", ".txt"), (6, docx(para("x")), ".docx"), (7, b"no", ".docx"), (8, b"x", ".exe"), (9, b"\xef\xbb\xbfok", ".md")]
    got = formats.sniff(spark.createDataFrame(rows, "id int, content binary, suffix string")).orderBy("id").collect()
    assert [r.format_error for r in got] == [None, "not a PDF", None, "binary data", "not UTF-8", None, "not a DOCX", "suffix", None]
    assert got[8].media_type == "text/markdown" and got[7].media_type is None


def sections(spark, kind, text):
    rows = kind(spark.createDataFrame([(1, text)], "document_id int, text string")).orderBy("section_no").collect()
    return [(r.section, r.text, r.line_start, r.line_end) for r in rows]


def test_text_sections(spark):
    assert sections(spark, formats.text_sections, "one\ntwo\n\n \nthree\n") == [("1", "one\ntwo", 1, 2), ("2", "three", 5, 5)]
    assert sections(spark, formats.text_sections, "hello\n") == [("1", "hello", 1, 1)]
    assert sections(spark, formats.text_sections, "\n \n") == [] and sections(spark, formats.text_sections, None) == []


def test_markdown_sections(spark):
    text = "intro\n# Top \nbody\n\n## Sub\n####### no\n#none"
    assert sections(spark, formats.markdown_sections, text) == [("Document", "intro", 1, 1), ("Top", "# Top \nbody", 2, 4), ("Sub", "## Sub\n####### no\n#none", 5, 7)]


def test_names_sizes_and_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    name = lambda s: one(safe_name(F.lit(s)))
    assert name("C:\\a\\b.pdf") == "b.pdf" and name("../x/ü\t.md ") == "ü.md" and name("dir/") == "document" and len(name("a" * 300)) == 255
    assert [one(file_size(F.lit(n))) for n in (0, 1024, 1600, 5 << 20)] == ["1 KB", "1 KB", "2 KB", "5.0 MB"]
    assert [one(progress(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 3), (9, 3))] == [0, 33, 100]
    assert one(title(F.lit("x" * 157))) == "x" * 157 and one(title(F.lit("x" * 158))) == "x" * 157 + "..."
    assert [one(is_follow_up(F.lit(q))) for q in ("And now?", "What is this", "Android phones", "Tell " * 20 + "it")] == [True, True, False, False]


def test_publishing_replaces_whole_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks = lambda rows: spark.createDataFrame(rows, "document_id int, ordinal int, text string")
    docs = spark.createDataFrame([(1, "ready"), (2, "failed")], "document_id int, status string")
    publish_chunks(chunks([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]), docs, path)
    got = publish_chunks(chunks([(1, 0, "new")]), docs, path)
    assert [(r.document_id, r.text) for r in got.collect()] == [(1, "new")]
