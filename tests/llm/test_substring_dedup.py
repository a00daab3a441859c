"""Operator 1 against a count of all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import substring_dedup
from lodestone.llm.op1_query import op1_substring_dedup
from lodestone.llm.substring_dedup import COVER, LENGTH, PERIOD, remove_repeats

from .conftest import SCHEMA, odd_rows, passage, with_extras, words


def brute(texts):
    seen = Counter(tuple(w[i : i + LENGTH]) for w in map(words, texts) for i in range(len(w) - LENGTH + 1))
    out = []
    for w in map(words, texts):
        gone = [False] * len(w)
        for i in range(len(w) - LENGTH + 1):
            if seen[tuple(w[i : i + LENGTH])] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def check(spark, rows):
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    key = lambda r: (str(r[0]), str(r[1]), *map(str, r[2:]))
    wanted = [(r[0], r[1], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


def test_the_cover_has_all_differences():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_odd_documents(spark):
    check(spark, odd_rows())


@pytest.mark.parametrize("seed", range(3))
def test_matches_at_all_shifts(spark, seed):
    random.seed(seed)
    stock = [passage(100 + k, 80).split() for k in range(4)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(random.randint(1, 5)):
            source = random.choice(stock)
            a = random.randint(0, 50)
            parts += source[a : a + random.randint(20, 45)] if random.random() < 0.8 else passage(random.randint(0, 999), 10).split()
        rows.append((i, " ".join(parts), "en", "a", 1))
    check(spark, rows)


def test_small_gatherings_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GATHERED", 50)
    check(spark, odd_rows())


def test_other_columns_stay_and_older_results_go(spark, odd):
    names = ("n_removed", "kept_text", "_known", "extra", "_key", "_row", "_cut", "none")
    got = remove_repeats(with_extras(odd, *names))
    assert got.columns[-3:] == ["n_words", "n_removed", "kept_text"] and {"extra", "_known", "_key", "_row", "_cut", "none"} <= set(got.columns) and got.count() == odd.count()


def test_empty(spark, empty):
    assert remove_repeats(empty).collect() == []


def test_query(spark, data):
    got = {r.doc_id: r for r in op1_substring_dedup(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert {d.doc_id: b[:2] for d, b in zip(docs, brute([d.text for d in docs]), strict=True)} == {i: (r.n_words, r.n_removed) for i, r in got.items()}


def test_covered():
    assert substring_dedup.covered(np.array([1]), 5, 3).tolist() == [False, True, True, True, False]
