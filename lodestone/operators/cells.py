"""Exact nearest vectors from stored cells.

Centroids are fitted once, on a bounded sample; every chunk is stored in the cell of its nearest centroid, a folder, and a
table beside the cells has the number of chunks of each and its radius, the widest angle between centroid and chunk. The
angle between a query and any chunk of a cell is at least that to the centroid less the radius. A batch of queries so reads
the nearest cells of each query first, and then only the cells that may hold something nearer than its k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import is_finite, norm
from lodestone.operators.retrieval import PLACES, QUERY_BLOCK, Nearest, query_groups, unit, vectors_by_group
from lodestone.session import new_path

#: Vectors that centroids are fitted on at most, rounds of fitting, and cells at most (a folder each).
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4_096
#: Cells of each query that are read before any is left out.
FIRST_CELLS = 2
#: Angles are compared with this much leave, for rounding.
LEAVE = 1e-5


def fitted(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; fewer if there are fewer different vectors."""
    vectors = np.unique(vectors, axis=0)
    centers = vectors[np.random.default_rng(seed).permutation(len(vectors))[:cells]]
    for _ in range(ROUNDS):
        nearest = np.argmax(vectors @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centers)
    return centers


def store_cells(chunks: DataFrame, path: str, within: Sequence[str] = (), cells: int | None = None) -> None:
    """Stores chunks (chunk_id, embedding, within) by cell at `path`, every one of them; vectors that semantic_topk() would
    leave out aren't stored. Vectors of each length have cells of their own. cells: for each length; by default about the
    square root of the number of chunks, MOST_CELLS at most."""
    spark = chunks.sparkSession
    usable = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", *within).filter(is_finite(F.col("embedding")) & (norm(F.col("embedding")) > 0))
    sizes = {r["size"]: r["count"] for r in usable.groupBy(F.size("embedding").alias("size")).count().collect()}  # a row for each length
    centers: dict[int, np.ndarray] = {}
    for size, count in sizes.items():
        some = usable.filter(F.size("embedding") == size)
        if count > SAMPLE:
            some = some.sample(min(1.0, 1.2 * SAMPLE / count), seed=7)
        rows = some.select("embedding").limit(SAMPLE).collect()
        sample = unit(np.array([r.embedding for r in rows], np.float64))[0] if rows else np.eye(1, size)
        centers[size] = fitted(sample, min(MOST_CELLS, cells or max(1, round(count**0.5))))
    first = dict(zip(centers, np.cumsum([0, *(len(c) for c in centers.values())]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((centers, first))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, first = shared.value
        for batch in batches:
            lengths = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            cell, angle = np.zeros(len(lengths), np.int32), np.zeros(len(lengths))
            for size, middle in centers.items():
                rows = np.flatnonzero(lengths == size)
                vectors = unit(np.asarray(batch["embedding"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size))[0]
                near = vectors @ middle.T
                best = np.argmax(near, axis=1) if len(rows) else np.zeros(0, np.int64)
                cell[rows] = first[size] + best
                angle[rows] = np.arccos(np.clip(near[np.arange(len(rows)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema)
    found = usable.mapInArrow(dealt, f"{fields}, cell int, angle double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = found.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, tasks // max(1, sum(map(len, centers.values())))))))
    spread.write.partitionBy("cell").parquet(f"{path}/chunks")
    counted = spark.read.schema(found.schema).parquet(f"{path}/chunks").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    middles = [(first[size] + i, c.tolist()) for size, middle in centers.items() for i, c in enumerate(middle)]
    counted.join(F.broadcast(spark.createDataFrame(middles, "cell int, center array<double>")), "cell").repartition(1).write.parquet(f"{path}/cells")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, within: Sequence[str] = (), first_cells: int = FIRST_CELLS) -> DataFrame:
    """semantic_topk_batch() from stored cells: query_id, chunk_id, similarity, rank, and how many cells each query read
    (cells_read) of those there are (cells)."""
    stored = new_path(spark, "query-vectors")
    queries.select("query_id", "embedding", *within).write.parquet(stored)
    queries, out = spark.read.parquet(stored), new_path(spark, "nearest-in-cells")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = spark.read.parquet(f"{path}/cells").collect()  # MOST_CELLS for each length of vectors at most
    if not rows:
        return spark.createDataFrame([], "query_id long, chunk_id long, similarity double, rank int, cells_read long, cells long")
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        _search_block(spark, path, query_groups(some, within), rows, k, within, first_cells).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _search_block(spark: SparkSession, path: str, groups: dict, cells: list, k: int, within: Sequence[str], first_cells: int) -> DataFrame:
    """The k nearest of one block of queries."""
    bounds = {key: {size: _least_angles(targets, cells) for size, (_, targets) in sizes.items()} for key, sizes in groups.items()}
    first = {(key, size): _nearest_cells(b, first_cells) for key, sizes in bounds.items() for size, b in sizes.items()}
    found = _read(spark, path, groups, cells, first, k, within)
    aside = new_path(spark, "first-cells")
    found.write.parquet(aside)
    found = spark.read.schema(found.schema).parquet(aside)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    least = {r.query_id: r.similarity for r in best(found).filter(F.col("rank") == k).collect()}  # a row for each query of the block
    rest, read = {}, []
    for (key, size), taken in first.items():
        ids, bound = groups[key][size][0], bounds[key][size]
        reach = np.array([least.get(i, -1.0) for i in ids.tolist()]) - 10.0**-PLACES
        near = np.cos(np.clip(bound - LEAVE, 0, np.pi)) >= reach[:, None]
        rest[key, size] = near & ~taken & (bound < np.inf)
        read += zip(ids.tolist(), (rest[key, size] | taken).sum(1).tolist(), strict=True)
    shares = spark.createDataFrame(read, "query_id long, cells_read long")
    if any(x.any() for x in rest.values()):
        found = found.unionByName(_read(spark, path, groups, cells, rest, k, within))
    return best(found).join(F.broadcast(shares), "query_id").withColumn("cells", F.lit(len(cells)).cast("long"))


def _least_angles(targets: np.ndarray, cells: list) -> np.ndarray:
    """For each query and cell, the least angle that a chunk of the cell may have; none for vectors of another length."""
    out = np.full((len(targets), len(cells)), np.inf)
    own = [i for i, c in enumerate(cells) if len(c.center) == targets.shape[1]]
    if own:
        centers = np.array([cells[i].center for i in own])
        angles = np.arccos(np.clip(targets @ centers.T, -1, 1))
        out[:, own] = np.maximum(0, angles - np.array([cells[i].radius for i in own]))
    return out


def _nearest_cells(bound: np.ndarray, many: int) -> np.ndarray:
    """The cells of each query with the least bounds."""
    taken = np.zeros(bound.shape, bool)
    best = np.argsort(bound, axis=1, kind="stable")[:, :many]
    np.put_along_axis(taken, best, True, axis=1)
    return taken & (bound < np.inf)


def _read(spark: SparkSession, path: str, groups: dict, cells: list, wanted: dict, k: int, within: Sequence[str]) -> DataFrame:
    """The nearest chunks in the cells that are wanted, of each query; other cells' folders are not read."""
    numbers = np.array([c.cell for c in cells])
    any_ = np.logical_or.reduce([x.any(0) for x in wanted.values()]) if wanted else np.zeros(len(cells), bool)
    by_cell = {int(numbers[i]): {at: np.flatnonzero(x[:, i]) for at, x in wanted.items() if x[:, i].any()} for i in np.flatnonzero(any_)}
    shared = spark.sparkContext.broadcast((groups, by_cell))
    chunks = spark.read.parquet(f"{path}/chunks").filter(F.col("cell").isin(sorted(by_cell)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, by_cell = shared.value
        held: dict[tuple, Nearest] = {}
        for batch in batches:
            cell = batch["cell"].to_numpy(zero_copy_only=False)
            for c in np.unique(cell).tolist():
                rows = batch.take(pa.array(np.flatnonzero(cell == c)))
                for key, size, chunk, vectors in vectors_by_group(rows, within, groups):
                    of = by_cell[c].get((key, size))
                    if of is None:
                        continue
                    ids, targets = groups[key][size]
                    if (key, size) not in held:
                        held[key, size] = Nearest(ids, k)
                    held[key, size].add(targets[of], chunk, vectors, of)
        for found in held.values():
            yield found.rows()

    return chunks.select("chunk_id", "embedding", *within, "cell").mapInArrow(nearest, "query_id long, chunk_id long, similarity double")
