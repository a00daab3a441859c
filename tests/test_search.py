"""Searches of trees of terms, over texts and over stored postings, against looking at every stretch."""

from __future__ import annotations

import random
import re

import pytest

from lodestone.config import Settings
from lodestone.operators import retrieval, search
from lodestone.session import new_path


def satisfied(way, words):
    """Whether a stretch has all that a way wants."""
    return all(t in words for t in way.terms) and all(any(tuple(words[i : i + len(p)]) == p for i in range(len(words))) for p in way.phrases)


def model(text, asked):
    """The score of a text: every stretch is looked at, and those that hold no other one count."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    ways = search.web_search(asked)
    wanted = {w for way in ways for w in way.wanted}
    ways = [w for w in ways if not set(w.excluded) & set(words)]
    good = {(p, q) for p in range(len(words)) for q in range(p, len(words)) if any(satisfied(w, words[p : q + 1]) for w in ways)}
    least = [(p, q) for p, q in good if (p + 1, q) not in good and (p, q - 1) not in good]
    score = sum(0.1 / (1 + sum(w not in wanted for w in words[p : q + 1])) for p, q in least)
    return round(score, 6) if least else None


def random_search(letters):
    def unit():
        return random.choice(letters) if random.random() < 0.7 else f'"{" ".join(random.choices(letters, k=random.randint(2, 3)))}"'

    def way():
        return " ".join([unit() for _ in range(random.randint(1, 3))] + [f"-{random.choice(letters)}"] * (random.random() < 0.3))

    return " or ".join(way() for _ in range(random.randint(1, 3)))


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(11)
    texts = [(i, " ".join(random.choices("abcdefg", (9, 5, 3, 2, 1, 1, 1), k=random.randint(0, 18)))) for i in range(150)] + [(1000, None), (1001, "")]
    frame = spark.createDataFrame(texts, "chunk_id long, text string").cache()
    return texts, frame, search.store_postings(frame, new_path(spark, "postings"), 8, slice_chunks=10)


def test_trees_equal_every_stretch(spark, corpus):
    texts, frame, stored = corpus
    random.seed(12)
    asked = ['"a b" or c d -e', "a", "a b c d e f g", '"a a" or g', "zz or a", "zz", "-a", "", *(random_search("abcdefg") for _ in range(40))]
    queries = search.parsed(spark.createDataFrame(list(enumerate(asked)), "query_id long, search string"))
    got: dict[int, list] = {}
    for r in search.search_stored(stored, queries, 7, buckets=8, first_slices=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.lexical_score))
    for k, one in enumerate(asked):
        scores = {i: s for i, t in texts if (s := model(t, one)) is not None}
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert got.get(k, []) == want, one
        if k < 12:
            assert [(r.chunk_id, r.lexical_score) for r in search.lexical_topk(frame, one, 7).orderBy("rank").collect()] == want, one


def test_bounds_hold_and_leave_slices_out(spark):
    random.seed(13)
    texts = [(i, " ".join(["a", "b"] * 10 if i < 20 else ["x"] * random.randint(0, 2) + ["a"] * random.randint(0, 1) + ["b"])) for i in range(2000)]
    stored = search.store_postings(spark.createDataFrame(texts, "chunk_id long, text string"), new_path(spark, "postings"), 8, slice_chunks=20)
    queries = search.parsed(spark.createDataFrame([(1, "a b")], "query_id long, search string"))
    bounds = search.slice_bounds(stored, queries, (), 8).collect()
    scores = {i: model(t, "a b") for i, t in texts}
    at = {r.chunk_id: r.slice for r in stored.filter("term = 'b'").selectExpr("explode(chunks) AS chunk_id", "slice").collect()}
    for r in bounds:
        assert max(s or 0 for i, s in scores.items() if at[i] == r.slice) <= r.bound + 1e-9
    best = sorted(((s, -i) for i, s in scores.items() if s), reverse=True)[:5]
    found = search.search_stored(stored, queries, 5, buckets=8, first_slices=12)
    assert [(r.lexical_score, -r.chunk_id) for r in found.orderBy("rank").collect()] == best
    assert sum(r.bound >= best[-1][0] for r in bounds) < len(bounds) / 2  # what is read beyond the first slices


def test_folders_without_terms_of_the_search_are_not_read(spark, corpus):
    _, _, stored = corpus
    queries = search.parsed(spark.createDataFrame([(1, "a")], "query_id long, search string"))
    plan = search.slice_bounds(stored, queries, (), 8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "places" not in plan


def test_retrieve_reads_stored_postings_within_knowledge_bases(spark):
    random.seed(14)
    letters = "a b c d e f g h i j".split()
    chunks = [(i, i % 7, random.choice(["k", "l", None]), None, " ".join(random.choices(letters, k=random.randint(0, 60)))) for i in range(120)]
    chunks = spark.createDataFrame(chunks, "chunk_id long, document_id long, knowledge_base string, embedding array<float>, text string")
    asked = [(q, random.choice(["k", "l"]), None, random.sample([*letters, "z"], q % 10 + 1)) for q in range(12)] + [(20, "k", None, None), (21, None, None, ["a"])]
    asked = spark.createDataFrame(asked, "query_id long, knowledge_base string, embedding array<float>, terms array<string>")
    stored = search.store_postings(chunks, new_path(spark, "postings"), 4, ["knowledge_base"], 16)
    settings = Settings(evidence_limit=20)
    columns = ["query_id", "chunk_id", "lexical_score", "retrieval_rank"]
    plain = retrieval.retrieve(chunks, asked, settings).select(columns).collect()
    assert sorted(plain) == sorted(retrieval.retrieve(chunks, asked, settings, stored, 4).select(columns).collect()) and plain


def test_an_empty_table_has_empty_postings(spark, corpus):
    _, frame, stored = corpus
    assert search.lexical_topk_stored(search.store_postings(frame.filter("false"), new_path(spark, "postings"), 8), "a", 3, 8).count() == 0
    assert search.search_stored(stored, search.parsed(spark.createDataFrame([], "query_id long, search string")), 3, buckets=8).count() == 0


def test_blocks_of_slices_that_come_in_many_batches(spark, tmp_path):
    """Stored blocks against those counted by hand: null, empty and repeated texts, slices over several batches, a null group;
    nothing is gathered by aggregation, which spills where a slice is large."""
    import random
    from collections import defaultdict

    random.seed(21)
    rows = [(i, random.choice(["a", "b", None]), random.choice([None, "", "...", " ".join(random.choices("x y z w é".split(), k=random.randint(1, 9)))])) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stored = search.store_postings(spark.createDataFrame(rows, "chunk_id long, kb string, text string"), str(tmp_path / "p"), 4, ["kb"], 20)
        got = stored.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = defaultdict(list)
    for i, kb, text in rows:
        for at, term in enumerate((text or "").replace(".", "").split(), 1):
            wanted[kb, term, i].append(at)
    found = {}
    for r in got:
        assert r.n == len(r.chunks) == len(r.sizes) and r.most == max(r.sizes) and r.chunks == sorted(r.chunks) and sum(r.sizes) == len(r.places)
        at = 0
        for c, n in zip(r.chunks, r.sizes, strict=True):
            assert (r.kb, r.term, c) not in found
            found[r.kb, r.term, c] = r.places[at : at + n]
            at += n
    assert {k: v for k, v in found.items() if k[0]} == {k: v for k, v in wanted.items() if k[0]}
    assert len({(r.kb, r.slice, r.term) for r in got}) == len(got) and len({r.slice for r in got}) > 2
