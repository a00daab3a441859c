"""Alignments against the tokenizers and plain sets, one document at a time."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment
from tests.llm.conftest import with_extras

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def model(docs):
    """The result rows of (doc_id, text)."""
    both, links, rows = alignment.Tokenizers(*PATHS), [], []
    for _, text in docs:
        links.append(Counter())
        rows.append([0, 0, 0, ""])
        if not text:
            continue
        a = both.byte.encode(f" {text}", add_special_tokens=False).ids
        b = both.piece.encode(text)
        ends, whole = [], f" {text}".encode()
        if not (b"".join(both.bytes_a[i] for i in a) == whole == b"".join(both.bytes_b[i] for i in b)):
            continue
        for ids, known in ((a, both.bytes_a), (b, both.bytes_b)):
            ends.append(np.cumsum([len(known[i]) for i in ids]).tolist())
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[side][bisect.bisect_left(common, e)].append(i)
        for g in range(len(common)):
            links[-1].update((i, j) for i in groups[0][g] for j in groups[1][g])
        written = ";".join(f"{','.join(map(str, groups[0][g]))}|{','.join(map(str, groups[1][g]))}" for g in range(len(common)))
        rows[-1] = [len(a), len(b), len(common), hashlib.sha256(written.encode()).hexdigest()]
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [
        (doc_id, *row[:3], own.total(), sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()), row[3])
        for (doc_id, _), row, own in zip(docs, rows, links, strict=True)
    ]


def compare(frame):
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = alignment.align_documents(frame, *PATHS).select(NAMES).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, model(rows)))


HARD = [
    " ", "  ", "a\n\nb", " a  b  c　 d e ", "x▁y z", "<|endoftext|> <s> </s> <0x0A> <unk>", "é ü\nñ 中文 字 \U0001f600 \x00 \x1c a\x85 b \x85c", "a" * 3000 + " =" * 200 + "=" * 500,
    "\n", "\na", "a\n", "a \nb\n c", "don't we're '’s  'll", "tab\t x\r\n y", "  x  ", "a  b  c", "̀ ́a ​ b", "　x", " 　 y", "é　 z   w",
]


def test_odd_rows(odd):
    compare(odd.select("doc_id", "text"))


def test_white_space_of_all_kinds(spark):
    compare(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").repartition(2))


def test_random_texts(spark):
    random.seed(31)
    parts = ["the", "été", " ", " ", " ", "\n", "\t", " ", "　", " ", "中", "12", "?!", "==", "́", "▁", "<s>", "\x1c"]
    compare(spark.createDataFrame([(i, "".join(random.choices(parts, k=random.randint(1, 30)))) for i in range(400)], "doc_id long, text string"))


def test_buckets_of_every_size(spark, odd, monkeypatch):
    monkeypatch.setattr(alignment, "BUCKET_BYTES", 200)
    monkeypatch.setattr(alignment, "STEP_BYTES", 300)
    compare(odd.select("doc_id", "text").filter("length(text) < 3000"))


def test_an_empty_table_and_other_columns(spark, odd, empty):
    assert alignment.align_documents(empty, *PATHS).count() == 0
    compare(with_extras(odd, "bucket", "PAIRS", "times", "n_a", "count", "best").filter("doc_id < 6"))
    text_ids = odd.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text").filter("length(text) < 400")
    compare(text_ids)


ends = st.lists(st.integers(1, 4), min_size=1, max_size=60).map(lambda x: np.cumsum(x).tolist())


@settings(max_examples=300, deadline=None)
@given(ends, ends)
def test_common_ends(a, b):
    last = max(a[-1], b[-1])
    a, b = ([*x, last] if x[-1] < last else x for x in (a, b))
    common = sorted(set(a) & set(b))
    assert alignment.align(a, b) == ([bisect.bisect_right(a, e) for e in common], [bisect.bisect_right(b, e) for e in common])


def test_long_runs_are_jumped():
    class Counted(list):
        looked = 0

        def __getitem__(self, at):
            Counted.looked += 1
            return super().__getitem__(at)

    run = Counted(range(1, 1 << 16))
    assert alignment.align(run, list(run)) == (list(range(1, 1 << 16)),) * 2
    assert Counted.looked < 100


def test_a_large_group_is_counted_before_it_is_paired(monkeypatch):
    tool = alignment.Aligner(*PATHS)
    chunk = (" " + "=" * 37 + "-" * 23 + "~" * 11).encode()
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    args = np.array([1, 2, 1, 3]), np.array([5, 5, 6]), np.array([0, 3]), np.array([0, 2]), np.array([3, 1]), np.array([2, 1]), np.array([0, 1])
    few = tool.links(*args)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 4096)
    for x, y in zip(few, tool.links(*args), strict=True):
        assert x.tolist() == y.tolist()
    tool.learn([chunk])
    assert tool.valid.room[0]


def test_the_query(spark, data):
    from lodestone.llm.op11_query import op11_token_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_token_alignment(spark, data).select(NAMES).collect())) == sorted(model(rows))
