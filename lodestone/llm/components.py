"""Connected components of an edge table, and joins on keys that very many rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written

#: Rows from which on a key is hot. There are at most as many hot keys as rows by this, so that a table of them, with a row
#: each, is small enough to broadcast.
HOT = 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """A table of the keys that more than HOT rows have; None if there is none."""
    hot = written(rows.groupBy(key).count().filter(F.col("count") > HOT).select(key), "hot-keys")
    return None if hot.isEmpty() else hot


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with table (a row a key): rows with a hot key meet a broadcast of their keys' part of it where they are,
    the others are shuffled. hot: the hot keys, if there are any."""
    if hot is None:
        return rows.join(table, key, how)
    keys = F.broadcast(hot)
    cold = rows.join(keys, key, "left_anti").join(table, key, how)
    return cold.unionByName(rows.join(keys, key, "left_semi").join(F.broadcast(table.join(keys, key, "left_semi")), key, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Each node takes the least label among its own and its neighbours', then the label of its label, until nothing
    changes. Minima are taken in part before they are shuffled, and a node with very many neighbours, or a root with very
    many nodes, is hot and not shuffled at all; each round is a table in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "component-labels")
    stars = hot_keys(both, "b")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("root").alias("next"))
        near = hot_join(both, seen, "b", hot=stars).groupBy(F.col("a").alias("node")).agg(F.min("next").alias("near"))
        nearer = written(labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "component-near")
        of = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        jumped = hot_join(nearer, of, "root", "left", hot_keys(nearer, "root")).select("node", "was", F.least("root", "jump").alias("root"))
        changed = written(jumped, "component-labels")
        labels = changed.select("node", "root")
        if changed.filter("root <> was").isEmpty():
            return labels
