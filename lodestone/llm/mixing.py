"""Mixing sources to target weights (operator 10) by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents by a seeded hash. A source's target gives its quota of block draws: whole
passes over all its blocks, then a part of them in permuted order, the last of which is drawn in part. A binary tree
over the output shards splits the quotas of all sources: at each node, the draws that go left are drawn without
replacement from those at the node. A shard so gets, of every source, a run of draws that no other shard has. Within a
shard, rows stand in the order of a hash, dealt to as many partitions as its size asks for.

A block that is drawn in part may be mostly one long document that doesn't fit. What then is missing is drawn from the
blocks that follow, until it is below a thousandth of the target or the source has no further block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import beside, partitions, unused, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SHARDS = 16
SEED = 20
#: Words and rows of a block, about; blocks of a source that would have more than MAX_BLOCKS are larger.
BLOCK_WORDS = 50_000
BLOCK_ROWS = 20_000
MAX_BLOCKS = 1 << 20
#: Words of an output partition, about.
PART_WORDS = 1 << 24
#: Share of a target that may be missing before more blocks are drawn from.
MISSING = 0.001
#: Tables of sources and blocks are broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def source_key(source: Column) -> Column:
    """Null-safe and in order of code points, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def row_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


@dataclass(frozen=True)
class Draws:
    """sources: _source, source_size, target, _blocks, ... draws: _source, _block, _shards (of each draw), _last (keys
    of the documents in the last draw; null if that takes all)."""

    sources: DataFrame
    draws: DataFrame
    few_sources: bool
    few_draws: bool
    seed: int

    def assign(self, rows: DataFrame) -> DataFrame:
        """rows (with doc_id and source) with source_size, target and shards: the shard of each time a row is taken."""
        ours = {c.lower() for c in (*self.sources.columns, *self.draws.columns, "_key")} - {"source_size", "target", "shards"}
        names = beside(rows.columns, "source_size", "target", "shards")
        away = {c: unused([*rows.columns, *ours], c) if c.lower() in ours else c for c in names}
        rows = rows.select(*(F.col(f"`{c}`").alias(away[c]) for c in names))
        own = [F.col(f"`{away[c]}`") for c in names]
        hint = lambda table, few: F.broadcast(table) if few else table
        keyed = rows.select(*own, source_key(F.col("source")).alias("_source"), row_key(self.seed).alias("_key"))
        sized = keyed.join(hint(self.sources, self.few_sources), "_source", "left")
        placed = sized.withColumn("_block", F.pmod("_key", "_blocks"))
        found = placed.join(hint(self.draws, self.few_draws), ["_source", "_block"], "left")
        partly = F.col("_last").isNotNull() & ~F.coalesce(F.array_contains("_last", F.col("_key")), F.lit(False))
        none = F.array().cast("array<int>")
        shards = F.when(partly, F.slice("_shards", 1, F.size("_shards") - 1)).otherwise(F.coalesce("_shards", none))
        return found.select(*(F.col(f"`{away[c]}`").alias(c) for c in names), "source_size", "target", shards.alias("shards"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds target to (_source, source_size): the weights in turn by source share `share` of all sizes; no target is
    above `most` times its source's size, and what is above is shared among the others by weight.

    With sources in ascending order of size over weight, those before some point get their most, and the level of the
    others is the largest of what any such point leaves to each unit of weight. A row for each source, so one task.
    """
    turn = Window.orderBy("_source")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.row_number().over(turn) - 1) % len(weights) + 1)
    table = sizes.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * most)
    order = Window.orderBy(F.col("_most") / F.col("_weight"), "_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    table = table.withColumn("_level", left / F.sum("_weight").over(after))
    target = F.least(F.col("_most"), F.col("_weight") * F.max("_level").over(everything))
    return table.select("_source", "source_size", target.cast("double").alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_source, _quota) to (_source, _starts): where each shard's run of the source's draws begins.

    A node holds a row for each source; its draws divide between its two halves in proportion to their shards.
    """
    schema = "node int, low int, high int, _source string, _quota long"
    nodes = quotas.select(F.lit(1).alias("node"), F.lit(0).alias("low"), F.lit(shards).alias("high"), "_source", "_quota")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_source", ignore_index=True)
        node, low, high = (int(rows[c].iloc[0]) for c in ("node", "low", "high"))
        if high - low == 1:
            return rows
        middle = (low + high) // 2
        quota = rows["_quota"].to_numpy(np.int64)
        part = int(quota.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(quota, part, method="marginals")
        halves = (rows.assign(node=2 * node, high=middle, _quota=left), rows.assign(node=2 * node + 1, low=middle, _quota=quota - left))
        return pd.concat(halves, ignore_index=True)

    for _ in range((shards - 1).bit_length()):
        nodes = nodes.groupBy("node").applyInPandas(split, schema)
    before = F.sum("_quota").over(Window.partitionBy("_source").orderBy("low")) - F.col("_quota")
    starts = nodes.select("_source", F.struct("low", before.alias("start")).alias("s"))
    return starts.groupBy("_source").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["start"]).alias("_starts"))


def choose(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block that is drawn in part: the largest first, each that still fits."""
    rows = rows.sort_values(["size", "_key"], ascending=[False, True], ignore_index=True)
    left, taken = float(rows["_rest"].iloc[0]), []
    for size, key in zip(rows["size"], rows["_key"], strict=True):
        if size <= left:
            left -= size
            taken.append(int(key))
    used = float(rows["_rest"].iloc[0]) - left
    return pd.DataFrame({"_source": [rows["_source"].iloc[0]], "_block": [rows["_block"].iloc[0]], "_last": [taken], "_taken": [used]})


def plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED
) -> tuple[DataFrame, Draws]:
    """The sizes of docs (doc_id, source, text) as (doc_id, source, size), and the draws of all sources.

    Null and empty texts have size 0. A null source is one source, the last. Rows with one doc_id and source are drawn
    together. Of equal sizes, the smaller hash is drawn first; very long documents are drawn whole or not at all. The same
    rows, parameters and seed give the same draws, in whatever order rows come. An empty table, or one without a word,
    has no draws.
    """
    slim = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    by = source_key(F.col("source")).alias("_source")
    sizes = slim.groupBy(by).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    blocks_of = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.ceil(F.col("_rows") / BLOCK_ROWS), F.lit(1))
    blocks_of = sizes.select("_source", F.least(F.lit(MAX_BLOCKS), blocks_of).cast("long").alias("_blocks"))
    sources = source_targets(sizes.select("_source", "source_size"), weights, share, most).join(blocks_of, "_source")
    size = F.greatest(F.col("source_size"), F.lit(1))
    passes = F.floor(F.col("target") / size)
    sources = sources.withColumn("_passes", passes).withColumn("_rest", F.col("target") - passes * F.col("source_size"))
    sources = written(sources, "mix-sources")
    few_sources = sources.count() <= BROADCAST_ROWS
    table = F.broadcast(sources) if few_sources else sources
    keyed = slim.select(by, row_key(seed).alias("_key"), "size").join(table, "_source").withColumn("_block", F.pmod("_key", "_blocks"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "_block"), "_block")
    blocks = keyed.groupBy("_source", "_block").agg(F.sum("size").alias("_words"))
    blocks = blocks.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("_source")))
    blocks = written(blocks, "mix-order")
    once = written(rest_draws(keyed, blocks, sources, few_sources), "mix-rest")
    drawn = blocks.join(F.broadcast(sources.select("_source", "_passes")) if few_sources else sources.select("_source", "_passes"), "_source")
    drawn = drawn.join(once.withColumn("_more", F.lit(True)), ["_source", "_block"], "left").withColumn("_more", F.coalesce("_more", F.lit(False)))
    drawn = written(drawn.filter((F.col("_passes") > 0) | F.col("_more")), "mix-blocks")
    quotas = drawn.groupBy("_source").agg(F.sum(F.col("_passes") + F.col("_more").cast("long")).alias("_quota"))
    starts = split_quotas(quotas, shards, seed)
    times = F.sequence(F.lit(0), (F.col("_passes") + F.col("_more").cast("long") - 1).cast("int"))
    shard = lambda t: (F.size(F.filter("_starts", lambda s: s <= t * F.col("_n") + F.col("_rank"))) - 1).cast("int")
    draws = drawn.join(starts, "_source").select("_source", "_block", F.transform(times, shard).alias("_shards"), "_last")
    draws = written(draws, "mix-draws")
    return slim, Draws(sources.select("_source", "source_size", "target", "_blocks"), draws, few_sources, draws.count() <= BROADCAST_ROWS, seed)


def rest_draws(keyed: DataFrame, blocks: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """(_source, _block, _last) of the blocks that sources are drawn from for what whole passes leave of their targets.

    Each round draws blocks in order as long as they fit and chooses documents of the first that doesn't; _last lists
    those, and is null for a whole block. The next round goes on behind that block with what is still missing.
    """
    schema = "_source string, _block long, _last array<long>, _taken double"
    hint = lambda table: F.broadcast(table) if few else table
    left = sources.filter("_rest >= 1").select("_source", F.col("_rest").alias("_left"), F.lit(-1).alias("_from"), (F.col("target") * MISSING).alias("_enough"))
    found = None
    while not left.isEmpty():
        upto = F.sum("_words").over(Window.partitionBy("_source").orderBy("_rank"))
        ahead = blocks.join(hint(left), "_source").filter(F.col("_rank") > F.col("_from")).withColumn("_upto", upto)
        reached = written(ahead.filter(F.col("_left") - F.col("_upto") + F.col("_words") >= 1), "mix-reached")
        whole = reached.filter(F.col("_upto") <= F.col("_left"))
        parts = reached.filter(F.col("_upto") > F.col("_left")).select("_source", "_block", "_rank", "_enough", (F.col("_left") - F.col("_upto") + F.col("_words")).alias("_rest"))
        inside = keyed.select("_source", "_block", "_key", "size").join(hint(parts.select("_source", "_block", "_rest")), ["_source", "_block"])  # a block a source
        inside = inside.groupBy("_source", "_block", "_key", "_rest").agg(F.sum("size").alias("size"))
        chosen = written(inside.groupBy("_source", "_block").applyInPandas(choose, schema), "mix-chosen")
        some = whole.select("_source", "_block", F.lit(None).cast("array<long>").alias("_last")).unionByName(chosen.filter(F.size("_last") > 0).select("_source", "_block", "_last"))
        found = some if found is None else found.unionByName(some)
        rest = parts.join(chosen.select("_source", "_taken"), "_source").withColumn("_left", F.col("_rest") - F.col("_taken"))
        left = written(rest.filter((F.col("_left") >= 1) & (F.col("_left") > F.col("_enough"))).select("_source", "_left", F.col("_rank").alias("_from"), "_enough"), "mix-left")
    return found if found is not None else blocks.filter(F.lit(False)).select("_source", "_block", F.lit(None).cast("array<long>").alias("_last"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with shard and repeat, each shard's rows in the order of a hash.

    A shard takes as many partitions of about PART_WORDS words as it needs, each with the next part of the order. Other
    columns stay; older ones of these two names are replaced. See plan() for the cases.
    """
    _, draws = plan(docs, **how)
    rows = draws.assign(docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")))
    keep = [F.col(f"_row.`{c}`").alias(c) for c in beside(docs.columns, "shard", "repeat")]
    taken = rows.select("doc_id", "_row", F.posexplode("shards").alias("repeat", "shard"))
    order = F.xxhash64(F.lit(draws.seed), F.lit("within"), "doc_id", "repeat")
    words = draws.sources.agg(F.sum("target")).first()[0] or 0
    shards = how.get("shards", SHARDS)
    parts = max(1, math.ceil(max(words / PART_WORDS, partitions(docs.sparkSession)) / shards))
    part = F.floor((F.shiftrightunsigned("_order", 32) * parts) / (1 << 32)).cast("int")  # even ranges of the order
    return taken.withColumn("_order", order).repartitionById(shards * parts, F.col("shard") * parts + part).sortWithinPartitions("shard", "_order").select(*keep, "shard", "repeat")
