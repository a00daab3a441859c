"""Operators 6 and 8 against plain Python."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, quality_rules
from lodestone.llm.op6_query import op6_fingerprints
from lodestone.llm.op8_query import op8_quality_rules

from .conftest import SCHEMA, passage, with_extras, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((r[0], len(text), text[: len(text) - half] + following[:half]))
    return out


def test_edited_texts(spark, odd):
    got = fingerprints.fingerprint(with_extras(odd, "sketch", "next_text", "extra")).collect()
    wanted = [(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in edits([(r.doc_id, r.text) for r in odd.collect()])]
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(wanted, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.edited_contained) if x is not None)
    assert all(r.near_edited is not None and r.near_next is not None for r in got)


def test_likeness_estimates_jaccard(spark):
    rows = []
    random.seed(1)
    for i in range(40):
        base = passage(300 + i, 400).split()
        rows.append((2 * i, " ".join(base), "en", "a", 1))
        rows.append((2 * i + 1, " ".join(base[: random.randint(50, 400)]), "en", "a", 1))
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, SCHEMA)).collect()}
    real = [len(shingles(rows[k][1]) & shingles(rows[k + 1][1])) / len(shingles(rows[k][1]) | shingles(rows[k + 1][1])) for k in range(0, 80, 2)]
    error = np.array(real) - [got[2 * k].near_next for k in range(40)]
    assert abs(error.mean()) < 0.03 and error.std() < 0.08


def test_equal_texts_have_equal_prints_and_sketches_merge(spark):
    a, b = passage(7, 300), passage(8, 300)
    rows = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"{a} {b}"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.sketches(rows).collect()}
    assert got[1].sketch == got[3].sketch and got[5].sketch == got[6].sketch == [] and got[5].least is None
    both = fingerprints.sketches(rows).filter("doc_id IN (1, 2)").agg(F.flatten(F.collect_list("sketch")).alias("s")).first().s
    assert set(both) <= set(got[4].sketch) and len(set(got[4].sketch) - set(both)) <= 4
    assert all(h < fingerprints.limit() for h in got[4].sketch)


def test_short_texts_in_a_long_one(spark):
    """Texts of 1 to 50 words that stand in one of 400: containment 1 wherever there is an estimate, and merging changes
    nothing of the long one's sketch, whatever the short one's has."""
    long = passage(11, 400).split()
    rows = [(0, " ".join(long))] + [(n, " ".join(long[7 * n : 7 * n + n])) for n in range(1, 51)]
    made = fingerprints.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    whole = made.filter("doc_id = 0").select(F.col("sketch").alias("whole"), F.col("least").alias("whole_least"))
    pairs = made.filter("doc_id > 0").join(F.broadcast(whole)).select(
        "doc_id", "sketch", "least", "whole", fingerprints.merged(F.col("sketch"), F.col("whole")).alias("merged"),
        fingerprints.containment(F.col("sketch"), F.col("whole"), F.col("least")).alias("contained"), fingerprints.likeness(F.col("sketch"), F.col("whole"), F.col("least"), F.col("whole_least")).alias("like"),
    ).collect()
    for r in pairs:
        assert r.least is not None and all(h < fingerprints.limit() for h in r.merged) and 0 <= r.like <= 1
        if r.doc_id >= 5:
            assert r.merged == r.whole and r.contained == (1.0 if r.sketch else None)
    assert sum(r.contained == 1 for r in pairs) > 40


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text):
    """Hashes of five words, each seeding the next, that are below a quarter of the range; and the least of all."""
    chain = lambda parts: functools.reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), parts, 42)
    w = words(text)
    hashes = {signed(chain(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else {signed(chain(["few", " ".join(w)]))} if w else set()
    return sorted(h for h in hashes if h < -(1 << 63) + (1 << 62)), min(hashes, default=None)


def plain_print(text):
    low, least = plain_sketch(text)
    hex_ = lambda h: f"{h & (1 << 64) - 1:x}"
    return " ".join(map(hex_, low)) if low or least is None else "~" + hex_(least)


def plain_likeness(a, b):
    (a, x), (b, y) = plain_sketch(a), plain_sketch(b)
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else float(x == y)


def test_query_6_by_plain_python(spark, data):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{data}/documents.parquet").collect())
    changed = {i: (t or "")[: len(t or "") - len(t or "") // 2] + (docs[(k + 1) % len(docs)][1] or "")[: len(t or "") // 2] for k, (i, t) in enumerate(docs)}
    got = {r.doc_id: r for r in op6_fingerprints(spark, data).collect()}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_print(text), plain_print(changed[i]))
        assert got[i].near_edited == pytest.approx(plain_likeness(text, changed[i])) and got[i].near_next == pytest.approx(plain_likeness(text, following))


def test_a_row_alone_follows_itself(spark, empty):
    one = fingerprints.fingerprint(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint(empty).collect() == []


def test_query_6(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    wanted = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, t in edits([(d.doc_id, d.text) for d in docs])}
    assert {r.doc_id: r.edited_sha256 for r in op6_fingerprints(spark, data).collect()} == wanted


def base(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_rules(spark, odd):
    got = quality_rules.base_statistics(with_extras(odd, "n_words", "_grams", "extra")).collect()
    for r in got:
        b = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert len(got) == odd.count()


def test_odd_documents_are_judged(spark, odd, empty):
    assert {"extra", "m_0", "length", "_own"} <= set(quality_rules.judge(with_extras(empty, "extra", "m_0", "length", "_own")).columns)
    got = quality_rules.judge(with_extras(odd, "kept", "extra", "m_0", "length", "_own")).collect()
    assert len(got) == odd.count() and all(r.kept is not None and not (r.kept and r.base_failed) for r in got)
    assert all((r.distance2 is None) == r.base_failed for r in got)
    assert quality_rules.judge(empty).collect() == []


FLOORS = np.diag(np.array(quality_rules.FLOORS) ** 2)


def least_determinant(rows):
    """Mean, covariance and half the logarithm of its determinant, of the best of all subsets of the core's size."""
    h = int(np.ceil(quality_rules.CORE * len(rows)))
    some = rows[np.array(list(itertools.combinations(range(len(rows)), h)))]
    away = some - some.mean(axis=1, keepdims=True)
    covariances = np.einsum("ski,skj->sij", away, away) / h + FLOORS
    best = int(np.argmin(np.linalg.slogdet(covariances)[1]))
    return some[best].mean(axis=0), covariances[best], np.linalg.slogdet(covariances[best])[1] / 2


def vectors(seed, n, far):
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 0.05, (n, 5)) @ rng.normal(0, 1, (5, 5)) + rng.normal(0, 1, 5)
    rows[:far] += rng.normal(0, 3, (far, 5))
    return rows


def test_estimates_have_the_least_determinant_of_all_subsets(spark):
    """In most groups; where no start leads there, one that is hardly larger."""
    groups = {f"g{k}": vectors(k, 9 + k % 4, k % 3) for k in range(12)}
    rows = [(g, *map(float, r)) for g, of in groups.items() for r in of]
    bare = spark.createDataFrame(rows, "_group string, " + ", ".join(f"{n} double" for n in quality_rules.NAMES))
    for few in (True, False):
        got = {r["_group"]: r for r in quality_rules.estimate(bare, few).collect()}
        assert set(got) == set(groups)
        best = {g: least_determinant(of) for g, of in groups.items()}
        assert all(got[g].n == len(of) and -1e-6 < got[g].logdet - best[g][2] < 0.05 for g, of in groups.items())
        same = [g for g in groups if got[g].logdet - best[g][2] < 1e-6]
        assert len(same) >= 10
        for g in same:
            middle, covariance, _ = best[g]
            assert np.allclose([got[g][f"m_{i}"] for i in range(5)], middle)
            assert np.allclose([got[g][f"v_{i}_{j}"] for i, j in quality_rules.PAIRS], [covariance[i, j] for i, j in quality_rules.PAIRS])


def test_distances_are_from_estimates_drawn_to_wider_ones(spark):
    """Two sources of one language and one of another, against exhaustive estimates of sources, languages and all."""
    rows = [(i, passage(400 + i, 30 + i % 50) + " " + "#" * (i % 5 // 4 * 9), "en" if i < 12 else "de", "s" if i < 6 else "t", 1) for i in range(18)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.judge(frame).orderBy("doc_id").collect()
    stats = quality_rules.base_statistics(frame).select("doc_id", *(c.alias(n) for n, c in quality_rules.vector().items())).orderBy("doc_id").toPandas()[quality_rules.NAMES].to_numpy()

    def level(of):
        middle, covariance, _ = least_determinant(of)
        d = np.einsum("ij,jk,ik->i", of - middle, np.linalg.inv(covariance), of - middle)
        return middle, covariance * max(np.sort(d)[int(np.ceil(len(d) / 2)) - 1] / quality_rules.MEDIAN_CHI2, 1), len(of) / (len(of) + quality_rules.SHRINK_ROWS)

    for own, wider in ((slice(0, 6), slice(0, 12)), (slice(6, 12), slice(0, 12)), (slice(12, 18), slice(12, 18))):
        (m, c, w), (m1, c1, w1), (m2, c2, _) = level(stats[own]), level(stats[wider]), level(stats)
        middle, covariance = w * m + (1 - w) * (w1 * m1 + (1 - w1) * m2), w * c + (1 - w) * (w1 * c1 + (1 - w1) * c2)
        away = stats[own] - middle
        wanted = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
        assert np.allclose([r.distance2 for r in got[own]], wanted, rtol=1e-6)
        assert [r.kept for r in got[own]] == [bool(d <= quality_rules.CUT and not r.base_failed) for d, r in zip(wanted, got[own], strict=True)]


def test_outliers_go_and_clean_documents_stay(spark):
    rows = [(i, passage(700 + i, 80), "en", "s", 1) for i in range(200)]
    rows += [(900 + i, " ".join(f"{w}***" for w in passage(950 + i, 80).split()), "en", "s", 1) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[900 + i] for i in range(20))


def test_query_8(spark, data):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op8_quality_rules(spark, data).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: base(t) for i, t in docs.items()}
