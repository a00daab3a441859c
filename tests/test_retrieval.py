"""Candidates, fusion and evidence on small tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import retrieval
from lodestone.operators.retrieval import Terms, web_search
from lodestone.session import new_path

SEMANTIC, LEXICAL = "query_id long, chunk_id long, similarity double, rank int", "query_id long, chunk_id long, lexical_score double, rank int"


def fused(spark, semantic, lexical, documents):
    one = spark.createDataFrame([(1, *r) for r in semantic], SEMANTIC)
    two = spark.createDataFrame([(1, *r) for r in lexical], LEXICAL)
    return retrieval.fuse(one, two).join(spark.createDataFrame(documents, "chunk_id long, document_id long"), "chunk_id")


def test_what_both_rankings_have_comes_first(spark):
    rows = fused(spark, [(1, 0.9, 1), (2, 0.8, 2)], [(2, 0.2, 1), (3, 0.1, 2)], [(1, 10), (2, 20), (3, 30)])
    best = retrieval.select_evidence(rows).orderBy("retrieval_rank").collect()
    assert [(r.chunk_id, r.evidence_id) for r in best] == [(2, "E1"), (1, "E2"), (3, "E3")]


def test_a_document_has_so_many_chunks_at_most(spark):
    rows = fused(spark, [(i, 1 - i / 10, i) for i in range(1, 6)], [], [(1, 1), (2, 1), (3, 2), (4, 1), (5, 2)])
    best = retrieval.select_evidence(rows, Settings(max_chunks_per_document=1)).orderBy("retrieval_rank").collect()
    assert [r.chunk_id for r in best] == [1, 3]


@pytest.mark.parametrize(("similarity", "score", "enough"), [(0.1, 0.001, False), (0.5, 0.001, True), (None, 0.02, True), (0.1, None, False), (None, None, False)])
def test_sufficiency(spark, similarity, score, enough):
    rows = spark.createDataFrame([(1, similarity, score)], "query_id long, similarity double, lexical_score double")
    assert retrieval.sufficiency(rows).first().sufficient is enough


def test_zero_and_short_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [0.0, 0.0], [1.0], None, [1.0, 1.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [inf, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors, 1)), "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in retrieval.semantic_topk(rows, [2.0, 0.0]).collect()] == [1, 5]
    assert retrieval.semantic_topk(rows, []).collect() == retrieval.semantic_topk(rows, [0.0, 0.0]).collect() == retrieval.semantic_topk(rows, [nan, 0.0]).collect() == []
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 0.0]), (7, [nan, 1.0]), (6, None), (5, [3.0]), (4, [None, 1.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.chunk_id) for r in retrieval.semantic_topk_batch(rows, asked).orderBy("query_id", "rank").collect()]
    assert got == [(5, 3), (9, 1), (9, 5)]


def test_many_queries_are_taken_in_blocks(spark, monkeypatch):
    random.seed(8)
    vector = lambda: [random.uniform(-1, 1) for _ in range(4)]
    rows = spark.createDataFrame([(i, vector(), i % 3) for i in range(60)], "chunk_id long, embedding array<float>, kb int")
    asked = rows.select(F.col("chunk_id").alias("query_id"), "embedding", "kb").filter("query_id < 20")
    once = retrieval.semantic_topk_batch(rows, asked, 5, ["kb"]).orderBy("query_id", "rank").collect()
    assert all(r.query_id % 3 == r.chunk_id % 3 for r in once) and {r.query_id: r.chunk_id for r in once if r.rank == 1} == {i: i for i in range(20)}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    assert retrieval.semantic_topk_batch(rows, asked, 5, ["kb"]).orderBy("query_id", "rank").collect() == once


def test_only_chunks_of_the_querys_model_are_evidence(spark):
    chunks = spark.createDataFrame([(i, i, "k", m, [1.0, i / 10], "red car") for i, m in enumerate("abab")], "chunk_id long, document_id long, knowledge_base string, embedding_model string, embedding array<float>, text string")
    asked = spark.createDataFrame([(1, "k", "a", [1.0, 0.0], ["red"])], "query_id long, knowledge_base string, embedding_model string, embedding array<float>, terms array<string>")
    assert {r.chunk_id for r in retrieval.retrieve(chunks, asked).collect()} == {0, 2}


def test_a_query_without_evidence_has_too_little(spark):
    rows = spark.createDataFrame([(1, 0.9, None)], "query_id long, similarity double, lexical_score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: (r.sufficient, r.n_evidence) for r in retrieval.sufficiency(rows, queries=asked).collect()}
    assert got == {1: (True, 1), 2: (False, 0)}


def test_searches():
    assert web_search('red "Blue sky" -green or x') == [Terms(("red",), (("blue", "sky"),), ("green",)), Terms(("x",))]
    assert web_search("") == [] and web_search("-only") == []


def model(text: str, terms: list[str]) -> float | None:
    """Cover density by looking at every stretch."""
    words = re.findall(r"[^\W_]+", text.lower())
    places = [i for i, w in enumerate(words) if w in terms]
    covers = set()
    for end in places:
        starts = [s for s in places if s <= end and {words[i] for i in places if s <= i <= end} == set(terms)]
        if starts:
            covers.add(max(starts))
    total = 0.0
    for start in covers:
        end = min(e for e in places if e >= start and {words[i] for i in places if start <= i <= e} == set(terms))
        inside = sum(start <= i <= end for i in places)
        total += 0.1 / (1 + (end - start) - (inside - 1))
    return round(total, 6) if covers else None


def test_cover_density_equals_a_plain_count(spark):
    random.seed(3)
    texts = [(i, " ".join(random.choices("a b c d e".split(), k=random.randint(0, 25)))) for i in range(60)]
    frame = spark.createDataFrame(texts, "chunk_id long, text string")
    stored = retrieval.store_postings(frame, new_path(spark, "postings"), 4)
    for terms in (["a"], ["a", "b"], ["a", "b", "c"]):
        wanted = {i: s for i, t in texts if (s := model(t, terms)) is not None}
        assert {r.chunk_id: r.lexical_score for r in retrieval.lexical_topk(frame, " ".join(terms), 100).collect()} == wanted
        assert {r.chunk_id: r.lexical_score for r in retrieval.lexical_topk_stored(stored, " ".join(terms), 100, 4).collect()} == wanted


def test_phrases_and_exclusions(spark):
    texts = [(1, "the red car"), (2, "red the car"), (3, "a red car, new"), (4, None), (5, "")]
    frame = spark.createDataFrame(texts, "chunk_id long, text string")
    stored = retrieval.store_postings(frame, new_path(spark, "postings"), 4)
    for search, found in (('"red car"', [1, 3]), ("red car -new", [1, 2]), ("the or new", [1, 2, 3]), ("", []), ('"the red" or new', [1, 3])):
        assert sorted(r.chunk_id for r in retrieval.lexical_topk(frame, search).collect()) == found
        assert sorted(r.chunk_id for r in retrieval.lexical_topk_stored(stored, search, 20, 4).collect()) == found


def test_queries_of_many_terms_are_matched_on_all_of_them(spark):
    random.seed(4)
    letters = "a b c d e f g h i j k".split()
    texts = [(i, " ".join(random.choices([*letters, "x"], k=random.randint(20, 90)))) for i in range(40)]
    texts += [(40, "a b c d e f g h"), (41, " ".join(letters))]  # the first lacks the last three terms
    chunks = spark.createDataFrame([(i, i, "k", None, t) for i, t in texts], "chunk_id long, document_id long, knowledge_base string, embedding array<float>, text string")
    asked = spark.createDataFrame([(1, "k", None, letters), (2, "k", None, ["b", "a", "b"])], "query_id long, knowledge_base string, embedding array<float>, terms array<string>")
    got = {(r.query_id, r.chunk_id): r.lexical_score for r in retrieval.retrieve(chunks, asked, Settings(evidence_limit=20, lexical_candidates=100)).collect()}
    for query, terms in ((1, letters), (2, ["a", "b"])):
        scores = {i: s for i, t in texts if (s := model(t, terms)) is not None}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert {i: s for (q, i), s in got.items() if q == query} == {i: scores[i] for i in best}


def test_places_go_on_from_block_to_block(spark):
    from lodestone.plans.retrieval_queries import numbered

    random.seed(6)
    rows = [(i, random.choice(["a", "b", None])) for i in random.sample(range(-50, 400), 200)]
    found = numbered(spark.createDataFrame(rows, "chunk_id long, source string"), 4)
    want = {i: sum(j < i for j, s in rows if s == source) for i, source in rows}
    assert {r.chunk_id: r.place for r in found.collect()} == want
    windows = [w for w in str(found._jdf.queryExecution().optimizedPlan()).splitlines() if "row_number()" in w and "Window" in w]
    assert windows and all("_block" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)


def test_the_index_shuffles_texts_and_not_their_postings(spark, data):
    from lodestone.plans import QUERIES

    plan = QUERIES["postings_index"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # what runs first stands last


def test_neighbours_by_number_are_found_without_all_pairs(spark, tmp_path):
    """rrf_fusion with one label and with several, against all pairs of a label."""
    from lodestone.plans.retrieval_queries import rrf_fusion

    rows = [(i * (1 + i % 3), 1 if i % 5 else 2, [float(i % 7 + 1), float(i % 11)]) for i in range(0, 1500)]
    rows = list({r[0]: r for r in rows}.values()) + [(100_000, None, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = rrf_fusion(spark, str(tmp_path))
    label = {r[0]: r[1] for r in rows}
    wanted = {(q, c): k for q in label if q % 100 == 0 and label[q] is not None for k, c in enumerate(sorted((c for c in label if label[c] == label[q]), key=lambda c: (abs(c - q), c))[:20], 1)}
    assert {(r.query_id, r.chunk_id): r.lexical_rank for r in got.collect() if r.lexical_rank} == wanted
    assert "Join Inner, (document_id" not in got._jdf.queryExecution().optimizedPlan().toString()
