"""Operator 2 against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone.llm import components as hot
from lodestone.llm import jaccard_join
from lodestone.llm.components import components
from lodestone.llm.jaccard_join import join_similar, keep_one
from lodestone.llm.op2_query import op2_jaccard_join

from .conftest import SCHEMA, odd_rows, passage, with_extras, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """For each row: class_id, n_links, n_copies, n_shingles."""
    sets: dict[frozenset, list] = {}
    for r in rows:
        sets.setdefault(shingles(r[1]), []).append(r[0])
    keys = [s for s in sets if s]
    links = {s: [t for t in keys if t is not s and 5 * len(s & t) >= 4 * len(s | t)] for s in keys}
    group = {}
    for s in keys:
        todo, members = [s], set()
        while todo:
            if (x := todo.pop()) not in members:
                members.add(x)
                todo += links[x]
        ids = [i for m in members for i in sets[m] if i is not None]
        group[s] = min(ids) if ids else None
    out = []
    for r in rows:
        s = shingles(r[1])
        out.append((r[0], *((group[s], len(links[s]), len(sets[s]), len(s)) if s else (r[0], 0, 1, 0))))
    return out


def check(spark, rows):
    got = join_similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_odd_documents(spark):
    check(spark, odd_rows())


def near_copies(n):
    random.seed(9)
    base = passage(50, 150).split()
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(random.randint(0, 3)):
            text[random.randrange(len(text))] = passage(random.randint(0, 10**6), 1)
        rows.append((i, " ".join(text), "en", "a", 1))
    return rows + [(1000 + i, passage(2000 + i, 40), "en", "a", 1) for i in range(50)]


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BRUTE_FORCE", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 32)
    check(spark, near_copies(150))


def test_one_of_each_group_stays(spark):
    rows = odd_rows() + near_copies(30)
    wanted = brute(rows)
    got = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    bare = [r for r in rows if not shingles(r[1])]
    classes = {w[1] for w, r in zip(wanted, rows, strict=True) if shingles(r[1])}
    assert sorted([str(r.doc_id) for r in got if shingles(r.text)]) == sorted(map(str, classes))
    assert sum(not shingles(r.text) for r in got) == len(bare)


def test_empty_and_other_columns(spark, empty, odd):
    assert join_similar(empty).collect() == [] and keep_one(empty).collect() == []
    more = with_extras(odd, "set", "class_id", "root", "n", "_key", "_place", "_bare", "_row")
    assert join_similar(more).count() == odd.count()
    assert keep_one(more).columns == more.columns


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_components_with_hot_nodes_and_roots(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT", 5)
    random.seed(12)
    edges = [(0, i) for i in range(1, 40)] + [(39, 50), (50, 60)] + [(60, 61 + i) for i in range(20)] + [(200 + random.randrange(30), 200 + random.randrange(30)) for _ in range(25)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT", 5)
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 1), (None, 2), (9, 3)], "k long, v long")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    for how in ("inner", "left"):
        got = hot.hot_join(rows, table, "k", how, hot.hot_keys(rows, "k"))
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_everything_hot(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "BRUTE_FORCE", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_PATHS", 2)
    check(spark, near_copies(40) + [(3000 + i, passage(77, 60), "en", "a", 1) for i in range(12)])


def test_another_similarity(spark):
    base = passage(60, 104).split()
    rows = [(0, " ".join(base), "en", "a", 1), (1, " ".join([*base[:52], "new", *base[53:]]), "en", "a", 1)]  # 95 of 105 shared
    of = lambda s: {r.doc_id: r.class_id for r in join_similar(spark.createDataFrame(rows, SCHEMA), s).collect()}
    assert of(0.9) == {0: 0, 1: 0} and of(0.91) == {0: 0, 1: 1}


def test_runs_follow_from_the_target():
    assert jaccard_join.runs_for(0.9999, 1) == 10 and jaccard_join.runs_for(0.9999, 3) == 20 and jaccard_join.runs_for(0.9, 3) == 5


def test_recall_on_a_larger_table(spark):
    """All links among 10,000 documents, by looking at every two that share one of their rarest shingles."""
    folder = "/root/testdata/sf0.1"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for i, text in docs:
        w = words(text)
        s = frozenset(hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([hash(tuple(w))] if w else [])
        sets.setdefault(s, []).append(i)
    often = Counter(h for s in sets for h in s)
    at, links = {}, Counter()
    for s in filter(None, sets):
        rare = sorted(s, key=lambda h: (often[h], h))[: len(s) - -(-4 * len(s) // 5) + 1]
        for t in {t for h in rare for t in at.get(h, ())}:
            if 5 * len(s & t) >= 4 * len(s | t):
                links[s] += 1
                links[t] += 1
        for h in rare:
            at.setdefault(h, []).append(s)
    wanted = {i: links[s] for s, ids in sets.items() for i in ids}
    got = {r.doc_id: r.n_links for r in op2_jaccard_join(spark, folder).collect()}
    assert all(got[i] <= n for i, n in wanted.items()) and sum(got.values()) >= 0.999 * sum(wanted.values()) > 0


def test_query(spark, data):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_jaccard_join(spark, data).collect())) == sorted(brute(docs))


def test_edges_of_many_buckets_become_few(spark):
    """A group that all buckets tie together has about an edge a member, not one for each bucket, and stays connected."""
    random.seed(13)
    pairs = {(a, b) for _ in range(20) for a in range(300) for b in [random.randrange(5)] if a > b} | {(500, 400), (500, 401)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    few = jaccard_join.fewer(edges)
    roots = lambda e: {r.node: r.root for r in components(e).collect()}
    assert roots(few) == roots(edges) and len(pairs) > 1000 and few.count() < 320


def test_blocks_are_stored_once(spark, monkeypatch):
    """Of a cluster in many blocks every set is stored once, not once for each block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 8)
    stored = {}
    own = jaccard_join.written

    def kept(df, name):
        stored[name] = own(df, name)
        return stored[name]

    monkeypatch.setattr(jaccard_join, "written", kept)
    check(spark, near_copies(100))
    sets = stored["join-sets"].filter("blocks > 1")
    assert stored["join-block-names"].count() > 4 and sets.count() == sets.select("set").distinct().count()
