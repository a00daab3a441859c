"""Operators 4, 5 and 7: held-out accuracy, and odd input."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, quality_knn, url_filter
from lodestone.llm.op4_query import op4_language_id
from lodestone.llm.op5_query import op5_quality_knn
from lodestone.llm.op7_query import RULES, op7_url_filter
from lodestone.llm.shared import is_training_row

from .conftest import with_extras

LARGER = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    rows = op4_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_documents(spark, odd, empty):
    profiles = language_id.learn(odd)
    rows = language_id.identify(with_extras(odd, "score", "extra", "judged", "_judged"), profiles).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and (r.score == 0 or r.lang_pred != "und")
    assert {r.lang_pred for r in rows} == {"en", "de", "und"}
    assert language_id.identify(empty, profiles).collect() == []
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_distance_by_hand(spark):
    profiles = language_id.learn(spark.createDataFrame([("aaa", "x"), ("bbb", "y")], "text string, lang string"))
    codes, counts = language_id.ngrams("aaa")
    assert len(codes) == 7 and counts.sum() == 3 + 4 + 3  # a; _a aa a_; _aa aaa aa_
    assert profiles.judge("aaa") == ("x", 1.0) and profiles.judge("BBB!") == ("y", 1.0) and profiles.judge("12 3") == ("und", 0.0)


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"wort{i * i} é-{'x' * (i % 90)}" for i in range(400))
    whole = language_id.ngrams(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(language_id, "PART_POINTS", size)
        parts = language_id.ngrams(text)
        assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def out_of_place(text, ranked):
    """The distance with plain Python: ranked maps each language to its n-grams by frequency."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    count = Counter(f" {w} "[i : i + n] for w in letters for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " ")
    own = sorted(count, key=lambda g: (-count[g], code(g)))[: language_id.DOCUMENT_SIZE]
    far = lambda of: sum(abs(of.index(g) - i) if g in of else language_id.PROFILE_SIZE for i, g in enumerate(own))
    away = {lang: far(of) / (language_id.PROFILE_SIZE * len(own)) for lang, of in ranked.items()} if own else {}
    return min(away, key=lambda lang: (away[lang], lang)) if away else "und", 1 - min(away.values()) if away else 0.0


def code(gram):
    found = 0
    for c in gram:
        found = found << 21 | ord(c)
    return found


def test_query_4_by_plain_python(spark, data):
    """The query's profiles, and every document's distance from them, counted with plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    counts = {}
    for d in docs:
        if d.text is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 5:
            for w in "".join(c if c.isalpha() else " " for c in d.text.lower()).split():
                counts.setdefault(d.lang, Counter()).update(f" {w} "[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " ")
    ranked = {lang: sorted(c, key=lambda g: (-c[g], code(g)))[: language_id.PROFILE_SIZE] for lang, c in counts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in op4_language_id(spark, data).collect()}
    for d in docs:
        lang, score = out_of_place(d.text or "", ranked)
        assert got[d.doc_id][0] == lang and got[d.doc_id][1] == pytest.approx(score)


def test_training_rows_are_those_asked_for(spark):
    got = spark.range(50).select("id", is_training_row(F.col("id")).alias("t")).collect()
    assert [r.t for r in got] == [zlib.crc32(str(r.id).encode()) % 5 != 0 for r in got]


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = op5_quality_knn(spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_quality_of_odd_documents(spark, odd, empty):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    voters = quality_knn.learn(odd, labels)
    rows = quality_knn.judge(with_extras(odd, "score", "extra"), voters).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if not r.text} == {voters.prior}
    assert quality_knn.judge(empty, voters).collect() == []
    none = quality_knn.learn(odd, labels.filter("label = 9"))
    assert {r.score for r in quality_knn.judge(odd, none).collect()} == {0.5}


def test_votes_are_those_of_the_nearest(spark, data):
    """The query's scores by sorting all cosines of every document."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(is_training_row(F.col("doc_id")))
    voters = quality_knn.learn(docs, labels)
    rows = docs.collect()
    placed = quality_knn.features(pa.chunked_array([[r.text for r in rows]]))
    vectors = (placed * voters.weights) @ voters.space
    got = {r.doc_id: r.score for r in op5_quality_knn(spark, data).collect()}
    for r, terms, vector in zip(rows, placed, vectors, strict=True):
        cosines = voters.vectors @ (vector / max(np.linalg.norm(vector), 1e-9))
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: quality_knn.NEIGHBOURS]
        weights = [max(float(cosines[k]), 0) ** quality_knn.SHARPNESS for k in near]
        wanted = sum(w * voters.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights) if sum(weights) and terms.any() else voters.prior
        assert got[r.doc_id] == pytest.approx(wanted, abs=2e-3)


def test_repeated_ids_teach_no_more_than_there_may_be_voters(spark, monkeypatch):
    monkeypatch.setattr(quality_knn, "MAX_VOTERS", 20)
    docs = spark.createDataFrame([(i % 3, f"text {i // 2}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, label int")
    assert len(quality_knn.learn(docs, labels).labels) == 20
    few = spark.createDataFrame([(1, "one"), (1, "one"), (2, "two")], "doc_id long, text string")
    assert len(quality_knn.learn(few, labels).labels) == 2


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/EN/1", "a.example.net", "/EN/1", "net/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://m.org/fr/?", "m.org", "/fr/", "org/fr/", "allow"),
        ("http://net", "net", "", None, None),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://internet/", "internet", "/", None, None),
        ("http://h?x://y.net/", "h", "", None, None),
        ("no scheme.net/", "", "", None, None),
        (None, "", "", None, None),
        ("://", "", "", None, None),
        ("http://a.net:80/", "a.net:80", "/", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), RULES).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_urls_that_were_held_out(spark):
    found = url_filter.evaluate(url_filter.labelled_urls(spark))
    assert found["precision"] > 0.95 and found["recall"] > 0.8 and found["rows"] > 150


def test_another_labelled_table(spark):
    rows = [(f"http://{w}{i}.com/", int(w == "zq")) for w in ("zq", "ab") for i in range(20)] + [(None, 1), ("http://x/", None)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(1, "http://zq99.com/"), (2, "http://ab99.com/"), (3, None)], "page_id long, url string")
    said = lambda table: {r.page_id: r.verdict for r in url_filter.judge(pages, (), table).collect()}
    assert said(labelled) == {1: "block", 2: "allow", 3: said(labelled)[3]}
    assert set(said(labelled.filter("label = 1")).values()) == {"block"} and set(said(labelled.filter("label = 0")).values()) == {"allow"}
    assert {r.score for r in url_filter.judge(pages, (), labelled.limit(0)).collect()} == {0.5}


def test_grams_of_host_and_path(spark):
    row = spark.createDataFrame([("ab", "")], "h string, p string").select(url_filter.grams("h", F.col("h")).alias("h"), url_filter.grams("p", F.col("p")).alias("p")).first()
    assert row.h == ["h^ab", "hab$", "h^ab$"] and row.p == []


def test_pages_keep_their_columns(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = url_filter.judge(with_extras(pages.limit(3), "host", "score", "extra", "_said", "row"), RULES)
    assert got.columns == ["page_id", "url", "html", "extra", "_said", "row", "host", "path", "rule", "verdict", "score"] and got.count() == 3
    assert url_filter.judge(pages.limit(0), RULES).collect() == []
    assert op7_url_filter(spark, data).count() == pages.count()
