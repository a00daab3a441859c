"""Operator 3: exact round trips, and draws against all ways to cut a word."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import piece_sampling
from lodestone.llm.op3_query import model_path, op3_piece_sampling
from lodestone.llm.piece_sampling import MARK, Sampler, decode, encode

from .conftest import with_extras


@pytest.fixture(scope="module")
def sampler():
    return Sampler(model_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=90), min_size=1, max_size=6))
def test_round_trip(sampler, texts):
    ids, counts = sampler.encode(pa.array(texts, pa.string()), np.arange(len(texts)))
    assert [t.decode() for t in sampler.decode(ids, counts)] == texts


def test_long_texts_are_cut_like_short_ones(sampler, monkeypatch):
    text = " ".join(f"word{i} {'x' * (i % 150)}" for i in range(300)) + "  "
    whole = sampler.encode(pa.array([text]), np.array([5]))
    monkeypatch.setattr(piece_sampling, "STEP_BYTES", 400)
    parts = sampler.encode(pa.array([text]), np.array([5]))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def ways(sampler, word):
    """All ways to cut the mark and a word, with their weights."""
    pieces, found = sampler.pieces, {}
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path())
    text = chr(MARK) + word

    def go(at, ids, weight):
        if at == len(text):
            found[tuple(ids)] = weight
        for end in range(at + 1, len(text) + 1):
            i = model.piece_to_id(text[at:end])
            if i != model.unk_id() and pieces.weights[i] > 0:
                go(end, [*ids, i], weight * pieces.weights[i])

    go(0, [], 1.0)
    return found


@pytest.mark.parametrize("word", ["the", "hello", "again"])
def test_draws_follow_the_weights(sampler, word):
    n = 20_000
    ids, counts = sampler.encode(pa.array([word] * n), np.arange(n))
    cuts = np.cumsum(counts)
    drawn = Counter(tuple(x.tolist()) for x in np.split(ids, cuts[:-1]))
    wanted = ways(sampler, word)
    total = sum(wanted.values())
    assert set(drawn) <= set(wanted)
    for way, weight in wanted.items():
        p = weight / total
        assert abs(drawn[way] - n * p) <= 5 * np.sqrt(n * p) + 1


def test_a_row_is_cut_alike_wherever_it_is(spark, odd):
    one = {(r.doc_id, r.text): r.ids for r in encode(odd, model_path()).collect()}
    two = {(r.doc_id, r.text): r.ids for r in encode(odd.repartition(7).limit(12), model_path()).collect()}
    assert two.items() <= one.items()


def test_odd_documents(spark, odd):
    rows = decode(encode(with_extras(odd, "ids", "decoded", "extra", "seed", "_seed"), model_path()), model_path())
    assert rows.columns[-3:] == ["ids", "n_pieces", "decoded"] and rows.filter("NOT (decoded <=> text)").count() == 0
    assert rows.filter("text IS NULL AND (n_pieces > 0 OR ids IS NOT NULL)").count() == 0
    assert rows.filter(F.size("ids") != F.col("n_pieces")).filter("text IS NOT NULL").count() == 0


def test_empty(spark, empty):
    assert decode(encode(empty, model_path()), model_path()).collect() == []


def test_query(spark, data):
    rows = op3_piece_sampling(spark, data)
    assert rows.filter("NOT lossless").count() == 0 and rows.count() == 200


def boundaries(sampler, word):
    """For each place in the mark and a word, the share of all ways, by weight, that have a cut there."""
    pieces, text = sampler.pieces, chr(MARK) + word
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path())
    ids = {(a, b): model.piece_to_id(text[a:b]) for a in range(len(text)) for b in range(a + 1, min(a + pieces.longest, len(text)) + 1)}
    edges = [(a, b, float(pieces.weights[i])) for (a, b), i in ids.items() if i != model.unk_id() and pieces.weights[i] > 0]
    forward, backward = np.zeros(len(text) + 1), np.zeros(len(text) + 1)
    forward[0] = backward[-1] = 1
    for a, b, w in sorted(edges):
        forward[b] += forward[a] * w
    for a, b, w in sorted(edges, reverse=True):
        backward[a] += backward[b] * w
    return forward * backward / forward[-1]


@pytest.mark.parametrize("block", [8192, 48])
def test_pieces_cross_any_place_of_a_long_word(sampler, monkeypatch, block):
    """Sums are rescaled and blocks end inside this word, and neither shows in where it is cut."""
    monkeypatch.setattr(piece_sampling, "BLOCK", block)
    word, n = ("thereinafter" * 9)[:100], 3_000
    ids, counts = sampler.encode(pa.array([word] * n), np.arange(n))
    sizes = np.array([len(sampler.decode(np.array([i]), np.array([1]))[0]) + 1 for i in range(sampler.pieces.size)])
    cuts = np.zeros(len(word) + 2)
    for way in np.split(ids, np.cumsum(counts)[:-1]):
        cuts[np.cumsum(sizes[way])] += 1
    wanted = boundaries(sampler, word)
    assert np.abs(cuts[1:101] / n - wanted[1:101]).max() < 0.05
    assert 0 < cuts[64] < n


def test_blocks_change_no_draw(sampler, monkeypatch):
    texts = ["a" * 700 + " short " + "neverthelessnotwithstanding" * 30, "https://host/" + "path-" * 150, "中文" * 200 + "\t" + "\U0001f600" * 90]
    whole = sampler.encode(pa.array(texts), np.arange(3))
    monkeypatch.setattr(piece_sampling, "BLOCK", 100)
    parts = sampler.encode(pa.array(texts), np.arange(3))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_a_very_long_run_is_lossless(sampler):
    text = "".join(chr(97 + i * i % 26) for i in range(60_000))
    ids, counts = sampler.encode(pa.array([text, "x"]), np.arange(2))
    assert [t.decode() for t in sampler.decode(ids, counts)] == [text, "x"]
