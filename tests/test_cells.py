"""Stored cells against a full scan, and top-k with running tops against numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.operators import cells, retrieval
from lodestone.session import new_path


def clustered(n, seed=5, size=8, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size)) * 3
    return [[float(x) for x in np.float32(middles[i % groups] + rng.normal(size=size) * 0.15)] for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    random.seed(5)
    rows = [(i, ("a", "b", None)[i % 3], v) for i, v in enumerate(clustered(900))]
    rows += [(1000 + i, "a", rows[i * 3][2]) for i in range(40)]  # ties, by copies
    rows += [(2000, "a", None), (2001, "a", [0.0] * 8), (2002, "b", [1.0, float("nan")] + [0.0] * 6), (2003, "a", [1.0, 2.0]), (2004, "b", [1.0, None] + [0.0] * 6), (2005, "a", [])]
    return spark.createDataFrame(rows, "chunk_id long, knowledge_base string, embedding array<float>").repartition(3).cache()


def asked(spark):
    vectors = clustered(25, seed=6)
    rows = [(i, ("a", "b", None)[i % 3], v) for i, v in enumerate(vectors)] + [(100, "a", [2.0, 1.0]), (101, "zz", vectors[0]), (102, "a", None), (103, "b", [0.0] * 8)]
    return spark.createDataFrame(rows, "query_id long, knowledge_base string, embedding array<float>")


@pytest.mark.parametrize("within", [[], ["knowledge_base"]])
def test_cells_equal_a_full_scan_and_leave_cells_out(spark, chunks, within):
    path = new_path(spark, "cells")
    cells.store_cells(chunks, path, within, cells=12)
    names = ["query_id", "chunk_id", "similarity", "rank"]
    found = cells.search_cells(spark, path, asked(spark), 7, within, first_cells=1)
    full = retrieval.semantic_topk_batch(chunks, asked(spark), 7, within)
    assert sorted(found.select(names).collect()) == sorted(full.select(names).collect())
    shares = [r.cells_read / r.cells for r in found.select("query_id", "cells_read", "cells").distinct().collect()]
    assert sum(shares) / len(shares) < 0.5
    plan = spark.read.parquet(f"{path}/chunks").filter("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_every_chunk_is_within_its_cells_radius(spark, chunks):
    path = new_path(spark, "cells")
    cells.store_cells(chunks, path)
    middles = {r.cell: r for r in spark.read.parquet(f"{path}/cells").collect()}
    rows = spark.read.parquet(f"{path}/chunks").collect()
    assert len(rows) == 941 and sum(m.n for m in middles.values()) == 941
    for r in rows:
        vector = np.array(r.embedding) / np.linalg.norm(r.embedding)
        assert np.arccos(np.clip(vector @ np.array(middles[r.cell].center), -1, 1)) <= middles[r.cell].radius + 1e-9


def test_no_chunks_and_no_queries(spark, chunks):
    path, none = new_path(spark, "cells"), chunks.filter("false")
    cells.store_cells(none, path)
    assert cells.search_cells(spark, path, asked(spark)).count() == 0
    cells.store_cells(chunks, path := new_path(spark, "cells"))
    assert cells.search_cells(spark, path, asked(spark).filter("false")).count() == 0


def test_running_tops_hold_ties_by_id():
    rng = np.random.default_rng(3)
    vectors = retrieval.unit(rng.integers(-2, 3, (6000, 3)).astype(float) + 1e-3)[0]
    ids, chunks = np.arange(5), rng.permutation(len(vectors))
    found = retrieval.Nearest(ids, 9)
    for at in range(0, len(vectors), 700):
        found.add(vectors[:5], chunks[at : at + 700], vectors[at : at + 700])
    near = np.rint(vectors[:5] @ vectors.T * 10**6)
    for q in range(5):
        assert found.chunks[q].tolist() == chunks[np.lexsort((chunks, -near[q]))[:9]].tolist()
