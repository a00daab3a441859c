"""N-gram Jaccard join (operator 2) by chosen paths.

A text's set is its runs of SHINGLE words. Equal sets make one class, and only classes are joined. A class carries a
sketch of its set, the least hash in each of BINS parts of the hash range; those are the tokens of its paths.

In each run a class goes to the buckets of its sampled tokens: a token is sampled if a hash of the path so far and the
token is below 1 / (similarity * number of tokens), so that two sets that are as similar as asked share one of their
samples on average. Buckets above BRUTE_FORCE classes split again by further tokens, up to LEVELS times; those that are
still large are tied together unseen. In small buckets all pairs are compared by their sketches, with five standard
deviations of leave. What may be similar so falls into clusters, and within a cluster every pair is compared exactly by
the whole sets, large clusters block against block: each block is stored once, and tasks read the two that they compare.

The runs are repeated until the target recall: a pair at the threshold shares a path of one token with probability
1 - exp(-1), one of two with 1 - exp(-(1 - exp(-1))), and so on, and runs_for() takes as many runs as bring the pairs that
no run finds at the deepest level below what the target leaves. Pairs nearer than the threshold, or in larger clusters by
way of others, are missed less often still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import HOT, components, hot_join, hot_keys
from lodestone.llm.rolling import Words, mixed
from lodestone.llm.shared import partitions, steps, written
from lodestone.session import new_path

SHINGLE = 5
SIMILARITY = 0.8
BINS = 64
EMPTY = 0xFFFFFFFF
#: Share of the pairs at the threshold that must be found, at whatever level.
TARGET_RECALL = 0.9999
BRUTE_FORCE = 128
LEVELS = 3
#: Standard deviations of a sketch's estimate by which two sets may be below the threshold and still be compared.
LEAVE = 5
#: Large buckets up to this many are broadcast.
BROADCAST_PATHS = 500_000
#: Blocks of a cluster: at most about this many classes and shingles each.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
#: Blocks that a task compares with one that it holds, about.
BLOCKS_AT_ONCE = 8
#: Columns of a block's incidence matrix that are multiplied at once.
COLUMNS = 4096
LINKED = "set long, root long, links long"
U = np.uint64


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """The runs after which a pair at the threshold is found with probability `recall`, whatever level it is found at."""
    found = 1.0
    for _ in range(levels):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


RUNS = runs_for(TARGET_RECALL)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each, and where each text's begin. A text of one to four
    words has one shingle, all of it; one without words has none."""
    counts = np.diff(words.starts)
    of, place = words.places()
    short = (counts > 0) & (counts < SHINGLE)
    chosen = np.flatnonzero(place + SHINGLE <= counts[of]) if len(of) else np.zeros(0, np.int64)
    values, owner = words.runs(SHINGLE)[chosen], of[chosen]
    if short.any():
        rows = np.flatnonzero(short)
        few = [np.bitwise_xor.reduce(mixed(words.hashes[a:b] + U(7) * np.arange(1, b - a + 1, dtype=U))) for a, b in zip(words.starts[rows], words.starts[rows + 1], strict=True)]
        few = mixed(np.array(few, U) + counts[rows].astype(U))
        values, owner = np.concatenate([values, few]), np.concatenate([owner, rows])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def digests(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each set: equal for equal sets."""
    sums = np.concatenate([[U(0)], np.cumsum(mixed(values ^ U(0x9E3779B97F4A7C15)))])
    return mixed(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(U)).view(np.int64)


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set, the least hash (32 bits) in each bin, or EMPTY."""
    rows = len(starts) - 1
    out = np.full(rows * BINS, EMPTY, np.uint32)
    cell = np.repeat(np.arange(rows), np.diff(starts)) * BINS + (values >> U(58)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = cell[1:] != cell[:-1]  # ascending in each text, so bins follow one another and the least stands first
    out[cell[first]] = np.minimum((values[first] >> U(20)).astype(np.uint32), EMPTY - 1)
    return out.reshape(rows, BINS)


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in steps(batches):
        values, starts = shingle_sets(Words(table["text"]))
        sketch = [x.tobytes() for x in sketches(values, starts)]
        columns = [table["doc_id"].combine_chunks(), table["_key"].combine_chunks(), pa.array(digests(values, starts)), pa.array(np.diff(starts).astype(np.int64)), pa.array(sketch, pa.binary())]
        yield from pa.table(columns, names=["doc_id", "_key", "set", "n", "sketch"]).to_batches()


def chosen(paths: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of each path by the sampled tokens of its sketch: row numbers, and new paths."""
    there = sketch != EMPTY
    tokens = mixed(sketch.astype(U) + (np.arange(BINS, dtype=U) << U(32)) + U(1))
    children = mixed(tokens ^ paths.view(U)[:, None])
    limit = np.minimum(2.0**64 / (similarity * np.maximum(there.sum(1), 1)), 2.0**64 - 4096).astype(U)
    rows, at = np.nonzero(there & (children < limit[:, None]))
    return rows, children[rows, at].view(np.int64)


def first_paths(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    runs = mixed(np.arange(1, RUNS + 1, dtype=U)).view(np.int64)
    for batch in batches:
        sketch, sets = unpacked(batch["sketch"]), batch["set"].to_numpy()
        for run in runs:
            rows, paths = chosen(np.full(len(sets), run), sketch, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sets[rows])], names=["path", "set"])


def next_paths(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch["set"].to_numpy()
        rows, paths = chosen(batch["path"].to_numpy(), unpacked(batch["sketch"]), similarity)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sets[rows])], names=["path", "set"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys out of batches that are sorted by them; many whole groups may come in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table[k].to_numpy()
            same &= column == column[last]
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin:
            yield table.slice(0, begin)
            held = table.slice(begin).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def spanning(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row of its component."""
    n = len(links)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(links, label[None, :], n).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches may be of sets as similar as asked."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    leave = LEAVE * np.sqrt(similarity * (1 - similarity) / np.maximum(either, 1))
    return same >= (similarity - leave) * either


def candidate_edges(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges that span what may be similar in each bucket."""
    for table in groups(batches, ["path"]):
        cuts = bounds(table, ["path"])
        sets, sketch = table["set"].to_numpy(), unpacked(table["sketch"])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        two = two[alike(sketch[two], sketch[two + 1], similarity)]
        a, b = [sets[two]], [sets[two + 1]]
        for first, size in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            part = sketch[first : first + size]
            label = spanning(alike(part[:, None, :], part[None, :, :], similarity))
            other = np.flatnonzero(label != np.arange(size))
            a.append(sets[first + other])
            b.append(sets[first + label[other]])
        edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of the representatives of classes in clusters."""
    for table in steps(batches):
        values, starts = shingle_sets(Words(table["text"]))
        right = np.flatnonzero(digests(values, starts) == table["set"].to_numpy())
        taken = table.take(pa.array(right)).select(["cluster", "set", "blocks"])
        cut = [values[starts[r] : starts[r + 1]].tobytes() for r in right]
        yield from taken.append_column("shingles", pa.array(cut, pa.binary())).to_batches()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    n = len(sets)
    if n == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    vocabulary, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    at, owner = number[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((n, n), np.float32)
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [first, first + COLUMNS])
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[owner[lo:hi], at[lo:hi] - first] = 1
        total += matrix @ matrix.T
    return total.astype(np.int64)


def links_among(sets: np.ndarray, block: np.ndarray, shingles: list[np.ndarray], apart: bool, similarity: float) -> tuple | None:
    """Exact links among some sets, or between those of different blocks alone: the sets that have some, an edge of each
    that spans its part, and how many."""
    ids, rows = np.unique(sets, return_index=True)  # repeated rows have the same set
    if len(ids) < 2:
        return None
    shared = intersections([shingles[r] for r in rows])
    size = np.array([len(shingles[r]) for r in rows])
    links = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(links, False)
    if apart:
        links &= block[rows][:, None] != block[rows][None, :]
    label = spanning(links)
    count = links.sum(1)
    some = np.flatnonzero(count)
    return ids[some], ids[label[some]], count[some]


def linked_batch(out: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["set", "root", "links"])


def verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Exact links within each small cluster."""
    for table in groups(batches, ["cluster"]):
        cuts = bounds(table, ["cluster"])
        sets, data = table["set"].to_numpy(), table["shingles"].to_pylist()
        found = (links_among(sets[a:b], sets[a:b], [np.frombuffer(x, U) for x in data[a:b]], False, similarity) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if out := [x for x in found if x is not None]:
            yield linked_batch(out)


def store_blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes each block of a large cluster as a file of its own, and names it. A retried task writes the same files."""
    files, folder = fs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    keys = ["cluster", "block"]
    for table in groups(batches, keys):
        cuts = bounds(table, keys)
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = table.slice(first, end - first)
            name = f"{folder}/{rows['cluster'][0]}-{rows['block'][0]}"
            ours = f"{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(ours) as sink, pa.ipc.new_file(sink, rows.schema) as writer:
                writer.write_table(rows)
            files.move(ours, name)
            yield pa.RecordBatch.from_pydict({"cluster": rows["cluster"][:1].to_pylist(), "block": rows["block"][:1].to_pylist()}, pa.schema([("cluster", pa.int64()), ("block", pa.int32())]))


def stored_block(path: str, cluster: int, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    files, folder = fs.FileSystem.from_uri(path)
    with files.open_input_file(f"{folder}/{cluster}-{block}") as source:
        rows = pa.ipc.open_file(source).read_all()
    return rows["set"].to_numpy(), [np.frombuffer(x, U) for x in rows["shingles"].to_pylist()]


def verify_blocks(batches: Iterator[pa.RecordBatch], path: str, similarity: float) -> Iterator[pa.RecordBatch]:
    """Exact links within a block (i = j) or between two blocks of a large cluster, which hold no more than two blocks."""
    held, ours = None, (np.zeros(0, np.int64), [])
    for batch in batches:
        for cluster, i, j in zip(*(batch[k].to_pylist() for k in ("cluster", "i", "j")), strict=True):
            if held != (cluster, i):
                held, ours = (cluster, i), stored_block(path, cluster, i)
            sets, data = ours
            other, more = (sets[:0], []) if i == j else stored_block(path, cluster, j)
            found = links_among(np.concatenate([sets, other]), np.repeat([i, j], [len(sets), len(other)]), data + more, i != j, similarity)
            if found is not None:
                yield linked_batch([found])


def buckets(classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(path, set) of all small buckets that hold more than one class, and the edges (a, b) of those that stay large:
    their classes share LEVELS sampled tokens, and each is tied to the least of them without a look at its sketch."""
    rows = written(classes.select("set", "sketch").mapInArrow(lambda batches: first_paths(batches, similarity), "path long, set long"), "join-paths")
    leaves = None
    for level in range(LEVELS):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("set").alias("least"))
        sizes = written(sizes.filter("size > 1"), "join-sizes")
        wide = sizes.filter(F.col("size") > BRUTE_FORCE).select("path", "least")
        few = wide.count() <= BROADCAST_PATHS
        wide = F.broadcast(wide) if few else wide
        # Rows of large buckets don't meet in one task: they stay where they are, or where there are very many large
        # buckets, none of which is then a large part of all, are shuffled.
        small = rows.join(wide, "path", "left_anti").join(sizes.select("path"), "path", "left_semi")
        leaves = small if leaves is None else leaves.union(small)
        large = written(rows.join(wide, "path").select("path", "set", "least"), "join-large")
        if level == LEVELS - 1 or large.isEmpty():
            break
        found = large.join(classes.select("set", "sketch"), "set").select("path", "set", "sketch")
        rows = written(found.mapInArrow(lambda batches: next_paths(batches, similarity), "path long, set long"), "join-paths")
    return leaves, large.filter("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()


def fewer(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same: each a is tied to its least b, and its other b to that. The many that a large
    group has from all its buckets so become about one for each of its members."""
    least = edges.withColumn("least", F.min("b").over(Window.partitionBy("a")))  # an a has a few rows for each run
    own = least.select("a", F.col("least").alias("b"))
    return own.unionByName(least.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def link_classes(rows: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(set, links, root) of the classes that have links. rows: as described; docs: _key and text of all rows."""
    spark = rows.sparkSession
    grouped = rows.filter("n > 0").groupBy("set").agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(grouped, "join-classes")
    leaves, tied = buckets(classes, similarity)
    paired = leaves.join(classes.select("set", "sketch"), "set").select("path", "set", "sketch")
    paired = paired.repartition(partitions(spark), "path").sortWithinPartitions("path")
    edges = written(paired.mapInArrow(lambda batches: candidate_edges(batches, similarity), "a long, b long").union(tied), "join-candidates")
    clusters = components(fewer(edges)).select(F.col("node").alias("set"), F.col("root").alias("cluster"))
    members = classes.select("set", "_key", "n").join(clusters, "set")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = written(members.join(sizes, "cluster").select("_key", "set", "cluster", blocks.alias("blocks")), "join-members")
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    sets = docs.join(wanted.hint("merge"), "_key").select("text", "set", "cluster", "blocks").mapInArrow(full_sets, "cluster long, set long, blocks int, shingles binary")
    sets = written(sets.select("cluster", block.alias("block"), "set", "blocks", "shingles"), "join-sets")
    small = sets.filter("blocks = 1").select("cluster", "set", "shingles").repartition(partitions(spark), "cluster").sortWithinPartitions("cluster")
    found = small.mapInArrow(lambda batches: verify(batches, similarity), LINKED)
    large, path = sets.filter("blocks > 1"), new_path(spark, "join-blocks")
    large = large.select("cluster", "block", "set", "shingles").repartition(partitions(spark), "cluster", "block").sortWithinPartitions("cluster", "block")
    named = written(large.mapInArrow(lambda batches: store_blocks(batches, path), "cluster long, block int"), "join-block-names")
    pairs = named.select("cluster", F.col("block").alias("i")).join(named.select("cluster", F.col("block").alias("j")), "cluster").filter("i <= j")
    pairs = pairs.repartition(partitions(spark), "cluster", "i", F.floor(F.col("j") / BLOCKS_AT_ONCE)).sortWithinPartitions("cluster", "i", "j")
    found = written(found.unionByName(pairs.mapInArrow(lambda batches: verify_blocks(batches, path, similarity), LINKED)), "join-links")
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    return written(links.join(roots.withColumnRenamed("node", "set"), "set"), "join-linked")


def described(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their sets' digests and sketches, and the ids, keys and texts alone."""
    plain = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = plain.mapInArrow(describe, f"doc_id {kind}, _key long, set long, n long, sketch binary")
    return written(rows, "join-rows"), plain


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of docs that are linked, the one with the least doc_id; see join_similar() for the cases.
    Texts without words stay."""
    rows, plain = described(docs)
    linked = link_classes(rows, plain.select("_key", "text"), similarity).select("set", "root")
    least = rows.filter("n > 0").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    groups = least.join(linked, "set", "left").groupBy(F.coalesce("root", "set")).agg(F.min("first").alias("first"))
    bare = rows.filter("n = 0").select("_key", F.lit(True).alias("_bare")).distinct()
    stay = written(groups.select("first._key", F.lit(False).alias("_bare")).union(bare), "join-stay")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found = docs.select(row, F.xxhash64("doc_id", "text").alias("_key")).join(stay, "_key")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_bare"))
    return found.withColumn("_place", place).filter((F.col("_place") == 1) | F.col("_bare")).select("_row.*")


def join_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, class_id, n_links, n_copies, n_shingles.

    class_id is the least doc_id of all that are linked, directly or by way of others; n_links counts the other sets
    with a Jaccard similarity of at least `similarity`, copies of one set counting once; n_copies counts the rows with
    this very set. Texts without words (null, empty, white space) link to nothing and are each alone. Repeated rows are
    copies of each other. Null ids are carried, and are nobody's class_id unless a class has no other. Very long texts
    are taken whole. A pair at exactly `similarity` is linked. Other columns are not read, whatever their names, and an
    empty table gives an empty one.
    """
    rows, plain = described(docs)
    linked = link_classes(rows, plain.select("_key", "text"), similarity)
    sets = rows.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    named = written(sets.join(linked, "set", "left").withColumn("root", F.coalesce("root", "set")), "join-named")
    ids = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = hot_join(named, ids, "root", hot=hot_keys(named, "root"))
    named = written(named.select("set", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies"), "join-classes")
    copied = named.filter(F.col("n_copies") > HOT).select("set")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set")).alias("set"))
    out = hot_join(out, named, "set", "left", None if copied.isEmpty() else copied)
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.col("n").alias("n_shingles"),
    )
