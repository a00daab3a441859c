"""File formats: names, media types, sniffing, and texts as sections."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.config import DEFAULTS
from lodestone.functions.batches import in_steps

# The media type of each suffix that may be uploaded.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
}
MAX_DOCX_BYTES = 200 * 1024 * 1024
HEADING = re.compile(r"^#{1,6}[ \t\n\x0b\f\r]+(.+?)[ \t\n\x0b\f\r]*$")
WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SECTIONS = "array<struct<section_no: int, text: string, page: int, section: string, line_start: int, line_end: int>>"


def media_type(suffix: Column) -> Column:
    """Null for a suffix that isn't allowed."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair)), suffix)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size_bytes, sha256, modified_at) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))


def docx_error(file: BinaryIO, max_expanded: int = MAX_DOCX_BYTES) -> str | None:
    """What is wrong with a file as a DOCX, from its table of members alone."""
    try:
        with zipfile.ZipFile(file) as archive:
            if sum(x.file_size for x in archive.infolist()) > max_expanded:
                return "expands too far"
            return None if {"[Content_Types].xml", "word/document.xml"} <= set(archive.namelist()) else "not a DOCX"
    except (zipfile.BadZipFile, ValueError, NotImplementedError):  # what a file too short to seek in raises goes by its system
        return "not a DOCX"


def _docx_errors(content: Column, max_expanded: int) -> Column:
    @F.pandas_udf(StringType())
    def check(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: docx_error(io.BytesIO(c), max_expanded) if c is not None else None)

    return check(content)


def text_error(content: Column) -> Column:
    return F.when(F.contains(content, F.lit(b"\x00")), "binary data").when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")


def sniff(files: DataFrame, max_expanded: int = MAX_DOCX_BYTES) -> DataFrame:
    """files (content, suffix) with media_type and format_error; the type is null where there is an error. A DOCX whose
    members are of more than max_expanded bytes together is one."""
    kinds = files.withColumn("_kind", media_type(F.col("suffix")))
    pdf = F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    zipped = F.when(F.col("suffix") == ".docx", F.col("content"))
    error = F.when(F.col("_kind").isNull(), "suffix").when(F.col("suffix") == ".pdf", pdf).when(F.col("suffix") == ".docx", _docx_errors(zipped, max_expanded)).otherwise(text_error(F.col("content")))
    rows = kinds.withColumn("format_error", error)
    return rows.withColumn("media_type", F.when(F.col("format_error").isNull(), F.col("_kind"))).drop("_kind")


def decoded(content: Column) -> Column:
    """UTF-8 without a byte-order mark, with one kind of line break."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), "^﻿", ""), "\r\n?", "\n")


def _in_sections(docs: DataFrame, cut: Callable[[str], list[tuple[str, str, int, int]]]) -> DataFrame:
    """Sections of each text by itself, without a shuffle: document_id, section_no and what `cut` gives."""

    kind = docs.schema["document_id"].dataType.simpleString()

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_steps(batches, "text"):
            found = [(row, number, *block) for row, t in enumerate(some["text"].to_pylist()) if t is not None for number, block in enumerate(cut(t), 1)]
            rows, *columns = zip(*found, strict=True) if found else [()] * 6
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            taken = some["document_id"].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=["document_id", "section_no", "text", "section", "line_start", "line_end"])

    return docs.select("document_id", "text").mapInArrow(sections, f"document_id {kind}, section_no int, text string, section string, line_start int, line_end int")


def text_blocks(text: str) -> list[tuple[str, str, int, int]]:
    """The blocks between blank lines, named by their numbers, with their first and last line."""
    found: list[tuple[str, str, int, int]] = []
    held: list[str] = []
    for number, line in enumerate([*text.split("\n"), ""], 1):
        if line.strip():
            held.append(line)
        elif held:
            found.append(("\n".join(held).strip(), str(len(found) + 1), number - len(held), number - 1))
            held = []
    return found


def markdown_blocks(text: str) -> list[tuple[str, str, int, int]]:
    """The parts from heading to heading, named by their headings; what is before the first is in `Document`."""
    found: list[tuple[str, str, int, int]] = []
    held, name, begin = [], "Document", 1
    lines = text.split("\n")
    for number, line in enumerate([*lines, None], 1):
        heading = HEADING.match(line) if line is not None else None
        if line is None or heading:
            if part := "\n".join(held).strip():
                found.append((part, name, begin, number - 1))
            held, begin = [], number
            name = heading[1] if heading else name
        held.append(line or "")
    return found


def text_sections(docs: DataFrame) -> DataFrame:
    """(document_id, section_no, text, section, line_start, line_end) of plain texts (document_id, text): the blocks
    between blank lines, counted from 1."""
    return _in_sections(docs, text_blocks)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """The same of Markdown: each heading begins a section that bears its name; text before the first is in `Document`."""
    return _in_sections(docs, markdown_blocks)


def docx_blocks(content: bytes) -> list[str]:
    """Paragraphs and tables in document order; a table's cells are joined by bars and its rows by line breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD_SPACE}body")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD_SPACE}t")).strip()
    found = []
    for block in body if body is not None else ():
        if block.tag == f"{WORD_SPACE}p":
            found.append(plain(block))
        elif block.tag == f"{WORD_SPACE}tbl":
            rows = [" | ".join(plain(c) for c in row.iter(f"{WORD_SPACE}tc")) for row in block.iter(f"{WORD_SPACE}tr")]
            found.append("\n".join(rows).strip())
    return [x for x in found if x]


def docx_pages(content: bytes) -> int | None:
    """The page count that the file claims; None if it has none that can be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            found = re.search(rb"<(?:\w+:)?Pages>\s*(\d+)\s*<", archive.read("docProps/app.xml"))
    except (KeyError, zipfile.BadZipFile):
        return None
    return int(found[1]) if found else None


def _listed(blocks: list[str], key: str) -> list[dict]:
    empty = {"page": None, "section": None, "line_start": None, "line_end": None}
    return [empty | {"section_no": i, "text": b, key: i if key == "page" else str(i)} for i, b in enumerate(blocks, 1)]


def docx_sections(files: DataFrame, max_pages: int = DEFAULTS.max_document_pages) -> DataFrame:
    """(document_id, page_count, error, sections) of DOCX files (document_id, content)."""

    kind = files.schema["document_id"].dataType.simpleString()
    section = pa.struct([("section_no", pa.int32()), ("text", pa.string()), ("page", pa.int32()), ("section", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])

    def extract(content: bytes | None) -> tuple[int | None, str | None, list[dict]]:
        try:
            pages = docx_pages(content)
            blocks = docx_blocks(content)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None, "unreadable", []
        error = "too many pages" if pages is not None and pages > max_pages else None if blocks else "no text"
        return pages, error, [] if error else _listed(blocks, "section")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_steps(batches, "content"):
            pages, errors, sections = zip(*map(extract, some["content"].to_pylist()), strict=True)
            columns = [some["document_id"], pa.array(pages, pa.int32()), pa.array(errors, pa.string()), pa.array(sections, pa.list_(section))]
            yield pa.RecordBatch.from_arrays(columns, names=["document_id", "page_count", "error", "sections"])

    return files.select("document_id", "content").mapInArrow(extracted, f"document_id {kind}, page_count int, error string, sections {SECTIONS}")


def extract_documents(files: DataFrame, max_pages: int = DEFAULTS.max_document_pages, max_expanded: int = MAX_DOCX_BYTES) -> tuple[DataFrame, DataFrame]:
    """What files (document_id, suffix, content) hold: (document_id, media_type, page_count, error) of each, and the
    sections (document_id, section_no, text, section, line_start, line_end) of those that can be read.

    Each goes by its media type: plain text, Markdown or DOCX. PDF needs a library that isn't part of this engine, so
    those are reported as not supported. A text without anything to read is an error, as is a format that isn't what
    its name says.
    """
    kinds = sniff(files, max_expanded)
    of = lambda suffix: kinds.filter(F.col("media_type") == MEDIA_TYPES[suffix])
    columns = ["document_id", "section_no", "text", "section", "line_start", "line_end"]
    plain = text_sections(of(".txt").select("document_id", decoded(F.col("content")).alias("text"))).select(columns)
    marked = markdown_sections(of(".md").select("document_id", decoded(F.col("content")).alias("text"))).select(columns)
    packed = docx_sections(of(".docx").select("document_id", "content"), max_pages)
    blocks = packed.select("document_id", F.explode("sections").alias("s")).select("document_id", "s.section_no", "s.text", "s.section", "s.line_start", "s.line_end")
    sections = plain.unionByName(marked).unionByName(blocks)
    found = sections.groupBy("document_id").agg(F.count("*").alias("_n"))
    rows = kinds.select("document_id", "media_type", "format_error").join(packed.select("document_id", "page_count", F.col("error").alias("_packed")), "document_id", "left").join(found, "document_id", "left")
    pdf = F.when(F.col("media_type") == MEDIA_TYPES[".pdf"], "not supported")
    error = F.coalesce("format_error", pdf, "_packed", F.when(F.coalesce("_n", F.lit(0)) == 0, "no text"))
    return rows.select("document_id", "media_type", "page_count", error.alias("error")), sections
