"""Ids of rows that are made from other rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_id(*parts: Column) -> Column:
    """An id in the usual form, from a digest of the parts, so that a retried task makes the same; nulls count."""
    digest = F.md5(F.array_join(F.array(*(p.cast("string") for p in parts)), "\x01", "\x02").cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
