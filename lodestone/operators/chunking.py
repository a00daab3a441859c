"""Cutting sections into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.batches import in_steps


def pieces(text: str, target: int, overlap: int) -> list[str]:
    """Chunks of at most `target` characters, each cut behind the last blank or line break in the second half of its
    window where there is one. The next begins `overlap` characters back, or at the first white space after that."""
    text = text.strip()
    found, at = [], 0
    while at < len(text):
        end = at + target
        if end < len(text):
            middle = at + max(target // 2, 1)
            gap = max(text.rfind(" ", middle, end), text.rfind("\n", middle, end))
            end = gap + 1 if gap >= 0 else end
        if piece := text[at:end].strip():
            found.append(piece)
        if end >= len(text):
            break
        back = max(at + 1, end - overlap)
        at = next((i for i in range(back, end) if text[i].isspace()), end)
    return found


def chunk_sections(sections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of sections (document_id, section_no, text): document_id, section_no, part (from 1 in each section),
    ordinal (from 0 in each document) and text. Chunks never cross sections; null and blank sections have none."""
    target, overlap = settings.chunk_target_characters, settings.chunk_overlap_characters

    kinds = [f"{c} {sections.schema[c].dataType.simpleString()}" for c in ("document_id", "section_no")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in in_steps(batches, "text"):
            found = [(row, part, piece) for row, t in enumerate(some["text"].to_pylist()) if t is not None for part, piece in enumerate(pieces(t, target, overlap), 1)]
            rows = pa.array([row for row, _, _ in found], pa.int64())
            columns = [some["document_id"].take(rows), some["section_no"].take(rows), pa.array([part for _, part, _ in found], pa.int32()), pa.array([piece for _, _, piece in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["document_id", "section_no", "part", "text"])

    parts = sections.select("document_id", "section_no", "text").mapInArrow(cut, f"{', '.join(kinds)}, part int, text string")
    order = Window.partitionBy("document_id").orderBy("section_no", "part")
    return parts.select("document_id", "section_no", "part", (F.row_number().over(order) - 1).alias("ordinal"), "text")


def chunk_guard(documents: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """document_id, n_chunks and status of each document: failed, with a message, without chunks or with too many."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    error = F.when(n == 0, "No readable text was found").when(n > settings.max_document_chunks, "The document has too many chunks")
    rows = documents.select("document_id").join(counts, "document_id", "left")
    return rows.select("document_id", n.alias("n_chunks"), F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("safe_error"))
