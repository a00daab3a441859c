"""Retrieval: semantic and lexical candidates, their fusion, and what becomes evidence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions.text import tokens
from lodestone.functions.vectors import cosine, is_finite, norm
from lodestone.operators.search import PLACES, Terms, all_of, lexical_topk, lexical_topk_stored, search_stored, store_postings, web_search  # noqa: F401
from lodestone.session import new_path

#: Query vectors that are broadcast at once; more go in several blocks.
QUERY_BLOCK = 4_096
#: Terms of all queries up to which they are broadcast; beyond it the join shuffles.
BROADCAST_TERMS = 500_000


def semantic_topk(chunks: DataFrame, vector: Sequence[float], k: int = DEFAULTS.semantic_candidates) -> DataFrame:
    """The k chunks (chunk_id, embedding) nearest to one vector by cosine, with similarity and rank. Exact.

    Similarities are rounded before they are ranked, so that equal ones go by chunk_id everywhere. Zero vectors, vectors
    of another length and those with a part that is null or not finite are left out.
    """
    target = F.array(*(F.lit(float(x)) for x in vector)).cast("array<double>")
    scored = chunks.withColumn("similarity", F.round(cosine(F.col("embedding"), target), PLACES)).filter("similarity IS NOT NULL")
    best = scored.select("chunk_id", "similarity").orderBy(F.desc("similarity"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id")))


def semantic_topk_batch(chunks: DataFrame, queries: DataFrame, k: int = DEFAULTS.semantic_candidates, within: Sequence[str] = ()) -> DataFrame:
    """For each query (query_id, embedding) the k nearest chunks, as query_id, chunk_id, similarity, rank; only those that
    are equal to the query in the columns `within`. Vectors are left out as in semantic_topk().

    Queries are broadcast in blocks of about QUERY_BLOCK; each task multiplies its chunks with a block and keeps the best
    of all that it has seen, so that what is shuffled is k rows a query and task, whatever the number of chunks. Of several
    blocks, each is worked on in a pass of its own, and what it finds is stored, so the driver never has more than one.
    """
    spark = chunks.sparkSession
    path = new_path(spark, "query-vectors")
    queries.select("query_id", "embedding", *within).write.parquet(path)  # the blocks and their number are of one reading
    queries = spark.read.parquet(path)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if blocks == 1:
        return best(_block(chunks, queries, k, within))
    path = new_path(spark, "semantic-blocks")
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        best(_block(chunks, some, k, within)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def query_groups(queries: DataFrame, within: Sequence[str]) -> dict[tuple, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The ids and unit vectors of a block of queries, by what they are held to and by length."""
    whole = queries.filter(is_finite(F.col("embedding")) & (norm(F.col("embedding")) > 0))
    groups: dict[tuple, dict[int, tuple[list, list]]] = {}
    for r in whole.select("query_id", "embedding", *within).collect():  # about QUERY_BLOCK rows
        ids, vectors = groups.setdefault(tuple(r[2:]), {}).setdefault(len(r.embedding), ([], []))
        ids.append(r.query_id)
        vectors.append(r.embedding)
    return {key: {size: (np.array(ids, np.int64), unit(np.array(vectors, np.float64))[0]) for size, (ids, vectors) in sizes.items()} for key, sizes in groups.items()}


def _block(chunks: DataFrame, queries: DataFrame, k: int, within: Sequence[str]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(query_groups(queries, within))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = shared.value, {}
        for batch in batches:
            for key, size, chunk, rows in vectors_by_group(batch, within, groups):
                ids, targets = groups[key][size]
                if (key, size) not in held:
                    held[key, size] = Nearest(ids, k)
                held[key, size].add(targets, chunk, rows)
        for found in held.values():
            yield found.rows()

    return chunks.select("chunk_id", "embedding", *within).mapInArrow(best, "query_id long, chunk_id long, similarity double")


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1, and which can be: others are left out."""
    lengths = np.linalg.norm(rows, axis=1)
    usable = np.isfinite(lengths) & (lengths > 0)
    return rows[usable] / lengths[usable, None], usable


def vectors_by_group(batch: pa.RecordBatch, within: Sequence[str], groups: dict) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """The chunks of a batch, with vectors at length 1, by what they are held to and by length; only what queries ask for."""
    lengths = batch["embedding"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    group = np.zeros(len(lengths), np.int64)
    keys: list[tuple] = [()]
    for name in within:
        coded = batch[name].dictionary_encode()
        values = [*coded.dictionary.to_pylist(), None]
        codes = coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
        both, group = np.unique(group * len(values) + codes, return_inverse=True)
        keys = [(*keys[x // len(values)], values[x % len(values)]) for x in both.tolist()]
    ids = batch["chunk_id"].to_numpy(zero_copy_only=False)
    for at, key in enumerate(keys):
        for size in groups.get(key, {}):
            rows = np.flatnonzero((group == at) & (lengths == size))
            if len(rows):
                flat = batch["embedding"].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                vectors, usable = unit(np.asarray(flat, np.float64).reshape(-1, size))
                yield key, size, ids[rows[usable]], vectors


class Nearest:
    """The k nearest chunks so far of each of some queries. Similarities are whole millionths, so that ties go by chunk_id."""

    AT_ONCE = 2_048
    UNIT = 10**PLACES

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.near = np.full((len(ids), k), -2 * self.UNIT, np.int64)  # below any similarity: no chunk
        self.chunks = np.zeros((len(ids), k), np.int64)

    def add(self, targets: np.ndarray, chunks: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None) -> None:
        """Chunks with their vectors, for the queries `of`, whose vectors are the targets (all, if not given)."""
        order = np.argsort(chunks, kind="stable")
        for at in range(0, len(order), self.AT_ONCE):
            some = order[at : at + self.AT_ONCE]
            near = np.rint(targets @ rows[some].T * self.UNIT).astype(np.int64)
            if len(some) > self.k:
                first = np.argpartition((-near << 12) + np.arange(len(some)), self.k - 1, axis=1)[:, : self.k]  # AT_ONCE < 2^12
                near, found = np.take_along_axis(near, first, 1), chunks[some][first]
            else:
                found = np.broadcast_to(chunks[some], near.shape)
            held = (slice(None) if of is None else of,)
            near = np.concatenate([self.near[held], near], axis=1)
            found = np.concatenate([self.chunks[held], found], axis=1)
            best = np.lexsort((found, -near), axis=1)[:, : self.k]
            self.near[held], self.chunks[held] = np.take_along_axis(near, best, 1), np.take_along_axis(found, best, 1)

    def rows(self) -> pa.RecordBatch:
        query, at = np.nonzero(self.near > -2 * self.UNIT)
        columns = [pa.array(self.ids[query]), pa.array(self.chunks[query, at]), pa.array(self.near[query, at] / self.UNIT)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "similarity"])


def postings(texts: DataFrame) -> DataFrame:
    """(chunk_id, term, pos) of every token of chunks (chunk_id, text); positions begin at 1."""
    placed = texts.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return placed.select("chunk_id", "term", (F.col("pos") + 1).alias("pos"))


def cover_rank(found: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """Cover-density rank of postings (keys, t, pos) of query terms alone; t numbers a query's terms.

    A cover is a least stretch in which all wanted terms occur (`wanted`: how many there are); each adds
    0.1 / (1 + words in it that are no query terms). A row (keys, lexical_score) for each key that has all of them.

    A posting begins a cover if each one before it comes again; that cover ends where the last of those has come, and
    each term once, unless the posting's own term has come again by then. So the number of terms is no limit.
    """
    all_ = Window.partitionBy(*keys)
    order, same = all_.orderBy("pos"), Window.partitionBy(*keys, "t").orderBy("pos")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), F.struct("pos", "n")
    numbered = found.withColumn("n", F.row_number().over(order))
    seen = numbered.select(*keys, "pos", "n", wanted.alias("wanted"), F.lead(here).over(same).alias("again"), F.lag("pos").over(same).isNull().alias("is_first"))
    last = F.greatest(here, F.max("again").over(before), F.max(F.when(F.col("is_first"), here)).over(all_))  # passes nulls over
    whole = (F.count_if("is_first").over(all_) == F.col("wanted")) & (F.count_if(F.col("again").isNull()).over(before) == 0)
    covers = seen.select(*keys, "pos", "n", "again", last.alias("last"), whole.alias("whole")).filter("whole AND (again IS NULL OR last < again)")
    noise = (F.col("last.pos") - F.col("pos")) - (F.col("last.n") - F.col("n"))
    return covers.groupBy(*keys).agg(F.sum(0.1 / (1 + noise)).alias("lexical_score"))


def ranked(rows: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(semantic: DataFrame, lexical: DataFrame, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, similarity, rank) and (query_id, chunk_id, lexical_score, rank)."""
    both = semantic.withColumnRenamed("rank", "semantic_rank").join(lexical.withColumnRenamed("rank", "lexical_rank"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    return both.withColumn("fused_score", F.round(part("semantic_rank") + part("lexical_rank"), 8))


def select_evidence(fused: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What of fused (with document_id) becomes evidence: at most some chunks of a document, then at most some of all,
    best first; with retrieval_rank and evidence_id E1, E2, ... of each query."""
    order = [F.desc("fused_score"), F.desc(F.coalesce("similarity", F.lit(-2.0))), F.desc(F.coalesce("lexical_score", F.lit(-1.0))), "chunk_id"]
    capped = fused.withColumn("_of", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order)))
    capped = capped.filter(F.col("_of") <= settings.max_chunks_per_document).drop("_of")
    best = capped.withColumn("retrieval_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    best = best.filter(F.col("retrieval_rank") <= settings.evidence_limit)
    return best.withColumn("evidence_id", F.concat(F.lit("E"), F.col("retrieval_rank").cast("string")))


def sufficiency(evidence: DataFrame, settings: Settings = DEFAULTS, queries: DataFrame | None = None) -> DataFrame:
    """For each query with evidence, or each of queries (query_id), whether any of it is near enough or matches well
    enough; a query without evidence has too little."""
    enough = (F.col("similarity") >= settings.min_semantic_similarity) | (F.col("lexical_score") >= settings.min_lexical_score)
    found = evidence.groupBy("query_id").agg(F.coalesce(F.bool_or(enough), F.lit(False)).alias("sufficient"), F.count("*").alias("n_evidence"))
    if queries is None:
        return found
    rows = queries.select("query_id").join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def retrieve(chunks: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS, stored: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Evidence of all queries (query_id, knowledge_base, embedding, terms) from chunks (chunk_id, document_id,
    knowledge_base, embedding, text), which are what the asker may see and is ready. Where both have embedding_model,
    only chunks of the query's are looked at.

    Vectors are compared within the knowledge base as in semantic_topk_batch(). The queries' terms are broadcast up to
    BROADCAST_TERMS of them, so that of all postings only those of a query are shuffled. A query matches lexically where
    all its terms occur, however many. A query without a vector or without terms has the other kind of candidate alone.

    stored: what store_postings() has stored of the chunks' texts, within the knowledge bases (and models), in `buckets`
    folders. Then no text is read, and of the postings only what may be among the best.
    """
    within = ["knowledge_base", *(["embedding_model"] if "embedding_model" in chunks.columns and "embedding_model" in queries.columns else [])]
    semantic = semantic_topk_batch(chunks, queries, settings.semantic_candidates, within)
    wanted = queries.withColumn("terms", F.array_distinct("terms"))
    if stored is not None:
        lexical = search_stored(stored, wanted.withColumn("ways", all_of(F.col("terms"))), settings.lexical_candidates, within, buckets)
    else:
        lexical = _searched(chunks, wanted, within, settings.lexical_candidates)
    fused = fuse(semantic, lexical, settings.rrf_k).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return select_evidence(fused, settings)


def _searched(chunks: DataFrame, queries: DataFrame, within: Sequence[str], k: int) -> DataFrame:
    terms = queries.select("query_id", *within, F.size("terms").alias("wanted"), F.posexplode("terms").alias("t", "term"))
    few = terms.count() <= BROADCAST_TERMS
    posts = chunks.select("chunk_id", *within, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    found = posts.join(F.broadcast(terms) if few else terms, [*within, "term"]).select("query_id", "chunk_id", "wanted", "t", "pos")
    scores = cover_rank(found, ["query_id", "chunk_id"], F.col("wanted"))
    return ranked(scores.withColumn("lexical_score", F.round("lexical_score", PLACES)), "lexical_score", k)
