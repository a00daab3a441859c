"""Chunks against their rules, whatever the text."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from lodestone.config import Settings
from lodestone.functions.batches import in_steps
from lodestone.operators.chunking import chunk_guard, chunk_sections, pieces


@given(st.text(alphabet="ab \n\t.", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces_keep_to_the_length_and_lose_nothing(text, target, overlap):
    found = pieces(text, target, overlap)
    assert all(0 < len(p) <= target and p == p.strip() and p in text for p in found)
    at = 0
    for p in found:
        at = text.index(p, max(0, at - target))
    assert "".join(text.split()) == "" or found
    if found:
        assert text.strip().startswith(found[0]) and text.strip().endswith(found[-1])
    rest = text
    for p in found:
        rest = rest.replace(p, " ", 1) if p in rest else rest
    assert set("".join(found)) >= set(text.split() and "".join(text.split()))


def test_cuts_behind_a_blank_in_the_second_half():
    assert pieces("aaaa bbbb cccc", 10, 0) == ["aaaa bbbb", "cccc"]
    assert pieces("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]
    assert pieces("", 10, 0) == [] and pieces(" \n", 10, 0) == []


def test_sections_don_t_mix(spark):
    settings = Settings(chunk_target_characters=500, chunk_overlap_characters=20)
    rows = [("d", 1, "alpha " * 200), ("d", 2, "beta " * 150), ("e", 1, None), ("f", 1, "  ")]
    got = chunk_sections(spark.createDataFrame(rows, "document_id string, section_no int, text string"), settings).orderBy("document_id", "ordinal").collect()
    assert all(("alpha" in r.text) != ("beta" in r.text) for r in got)
    assert [r.ordinal for r in got] == list(range(len(got)))
    assert [r.part for r in got if r.section_no == 2][0] == 1
    docs = spark.createDataFrame([("d",), ("e",), ("f",)], "document_id string")
    chunks = chunk_sections(spark.createDataFrame(rows, "document_id string, section_no int, text string"), settings)
    assert {r.document_id: r.status for r in chunk_guard(docs, chunks).collect()} == {"d": "ready", "e": "failed", "f": "failed"}


def test_batches_are_cut_by_bytes():
    texts = ["a" * 600, None, "b" * 500, "", "c" * 5_000, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [b["text"].to_pylist() for b in in_steps(iter([batch, batch.slice(0, 0)]), "text", 1_000)]
    assert got == [["a" * 600, None], ["b" * 500, ""], ["c" * 5_000], ["d"]]
