"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import ORACLES, QUERIES


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else v
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    found = QUERIES[name](spark, data)
    got = [tuple(r) for r in found.collect()]
    if name not in ORACLES:
        assert got
        return
    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, got) == rows(wanted.columns, wanted.fetchall())
