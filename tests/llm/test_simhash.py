"""Fingerprints and components against plain Python, and links against comparing all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.op12_query import op12_simhash_dedup
from tests.llm.conftest import SCHEMA, passage, with_extras, words

COLUMNS = ["doc_id", "fingerprint", "component_id"]


def model_print(text):
    found = [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in words(text)]
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def model_components(rows):
    """The least id of everything that can be reached, by comparing all pairs of fingerprints."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {p: least.get(find(p)) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def check(frame):
    rows = [(r.doc_id, model_print(r.text)) for r in frame.collect()]
    of = model_components(rows)
    want = sorted((str(i), signed(p), str(of[p])) for i, p in rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame).select(COLUMNS).collect())
    assert got == want


def test_odd_rows(odd):
    check(odd)


def test_columns_of_any_name(odd):
    check(with_extras(odd, "fingerprint", "component_id", "variant", "_text", "_rest", "root", "DOC_ID_"))
    kept = simhash.fingerprints(with_extras(odd, "FINGERPRINT", "_text", "_rest", "Extra"))
    assert kept.columns == [*odd.columns, "_text", "_rest", "Extra", "fingerprint"] and kept.count() == odd.count()


def test_an_empty_table_and_one_of_nulls(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    check(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None)], SCHEMA))


def test_near_copies_chain_into_components(spark):
    """A chain of texts, each with one more word changed: neighbours are linked, the ends are not."""
    random.seed(8)
    base, rows = passage(80, 500).split(), []
    for i in range(120):
        base[random.randrange(500)] = f"new{i}"
        rows.append((200 - i, " ".join(base), "en", "a", 1))
    rows += [(1000 + i, rows[5][1], "en", "a", 1) for i in range(300)]  # one large group of copies
    frame = spark.createDataFrame(rows, SCHEMA)
    check(frame)
    found = simhash.near_duplicates(frame)
    assert found.select("component_id").distinct().count() < 90


def test_pairs_of_fingerprints_and_their_chains(spark):
    """Balls that overlap, bits at both ends, and many within one ball."""
    random.seed(9)
    middles = [random.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {m ^ (1 << a) ^ (1 << b) for m in middles for a, b in [(random.randrange(64), random.randrange(64)) for _ in range(25)] + [(0, 63), (63, 63), (62, 63)]}
    prints |= {middles[0] ^ (1 << a) for a in range(64)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    want = {(signed(a), signed(b)) if signed(a) < signed(b) else (signed(b), signed(a)) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    got = simhash.near_pairs(frame).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() == r.distance for r in got)
    chains = {(r.a, r.b) for r in simhash.near_chains(frame).collect()}
    assert chains <= want
    assert len(chains) <= len(want)
    root = model_components([(signed(p), p) for p in prints])
    from lodestone.llm.components import components

    linked = {r.node: r.root for r in components(simhash.near_chains(frame)).collect()}
    assert all(linked.get(signed(p), signed(p)) == root[p] for p in prints)


def test_a_group_of_copies_of_most_rows(spark):
    from unittest.mock import patch

    rows = [(i, "the same text for all of them", None, None, 0) for i in range(400)] + [(1000 + i, passage(500 + i, 30), None, None, 0) for i in range(50)]
    with patch("lodestone.llm.components.HOT", 100):
        found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
        assert {r.component_id: r["count"] for r in found.filter("doc_id < 1000").groupBy("component_id").count().collect()} == {0: 400}
    assert found.count() == 450


def test_long_texts_are_counted_in_parts():
    text = " ".join(str(i * i) for i in range(simhash.AT_ONCE + 500)).encode()
    split = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(split[i : i + 3]), 42) for i in range(len(split) - 2)], np.uint64)
    bits = sum(int(2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes)) << b for b in range(64))
    assert simhash.fingerprint(text) == bits


def test_the_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, model_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    of = model_components(rows)
    got = op12_simhash_dedup(spark, data)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{p:016x}", of[p]) for i, p in rows)
    assert got.filter(F.length("fingerprint") != 16).count() == 0
