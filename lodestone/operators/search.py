"""Full-text search: what a search asks for, cover density of the whole of it, and batch search over stored postings.

A search is a tree: alternatives ("or") of terms and phrases that must all occur, and of words that must not. A cover is a
least stretch of a chunk that satisfies the tree, whichever alternative does it; it adds 0.1 / (1 + words in it that are no
words of the search). An alternative whose excluded word a chunk has doesn't count for that chunk.

Postings are stored in blocks: one row for each term of a slice of some thousand chunks, in folders by a hash of the term,
with the number of chunks and the most that any has of the term. From these alone the score of a slice for a search is
bounded. A batch of searches looks up its rarest terms first, then its other terms in the slices found; it reads the blocks
of the few best slices of each search, and then only of those slices whose bound reaches the k-th best score so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.session import new_path

PLACES = 6
#: Chunks of a slice, about: a task has the blocks of one slice at once.
SLICE_CHUNKS = 8_192
#: Chunks that a slice of a small table has at least, when it is cut so that all tasks have one.
LEAST_SLICE = 256
#: Groups of chunks (such as knowledge bases) whose sizes are broadcast.
BROADCAST_GROUPS = 100_000
#: Slices of each search that are read before any is left out.
FIRST_SLICES = 4
#: Searches that meet the blocks of a slice in one task, about.
SEARCHES_AT_ONCE = 65_536
#: Terms whose blocks leave a task at once.
TERMS_AT_ONCE = 4_096
_FAR = np.int64(1) << 62
WAYS = "array<struct<terms: array<string>, phrases: array<array<string>>, excluded: array<string>>>"


@dataclass(frozen=True)
class Terms:
    """One way to match: all of terms and phrases, none of excluded."""

    terms: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = field(default=())

    @property
    def wanted(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *(w for p in self.phrases for w in p)]))


def web_search(text: str) -> list[Terms]:
    """Alternatives of a search as people type it: words are all wanted, "or" parts alternatives, quoted words stand
    together, and words after a minus must not occur."""
    found: list[Terms] = []
    for part in re.split(r"\s+or\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", text, flags=re.IGNORECASE):
        terms, phrases, excluded = [], [], []
        for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', part):
            words = re.findall(r"[^\W_]+", (quoted or plain).lower())
            if minus:
                excluded += words
            elif len(words) > 1:
                phrases.append(tuple(words))
            else:
                terms += words
        if terms or phrases:
            found.append(Terms(tuple(terms), tuple(phrases), tuple(excluded)))
    return found


def all_of(terms: Column) -> Column:
    """An array of terms that must all occur, as the ways of a search; none for a null or empty array."""
    one = F.array(F.struct(terms.alias("terms"), F.array().cast("array<array<string>>").alias("phrases"), F.array().cast("array<string>").alias("excluded")))
    return F.when(F.size(terms) > 0, one).otherwise(F.array()).cast(WAYS)


# Cover density. Places of many chunks are one line of numbers: a chunk's number in the upper half, the place in the lower.


def _in_chunks(places: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Those of ascending places that are in some of ascending chunks; few are looked up, many compared."""
    low, high = np.searchsorted(places, chunks << 32), np.searchsorted(places, (chunks + 1) << 32)
    sizes = high - low
    return places[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _ends(starts: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Where the next occurrence from each place on ends, or _FAR if it is not in the same chunk."""
    k = np.searchsorted(starts, at)
    found = np.append(starts, _FAR)[k]
    return np.where(found >> 32 == at >> 32, found + length - 1, _FAR)


def cover_scores(ways: Sequence[Terms], places: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks that a search matches, and their scores (rounded), from the ascending places of its words."""
    none = np.zeros(0, np.int64)
    parts: list[list[tuple[np.ndarray, int]]] = []
    matched = []
    for way in ways:
        words = sorted(way.wanted, key=lambda w: len(places.get(w, none)))  # rarest first: what is rare decides where to look
        chunks = np.unique(places.get(words[0], none) >> 32)
        near: dict[str, np.ndarray] = {}
        for word in words:
            near[word] = _in_chunks(places.get(word, none), chunks)
            chunks = np.unique(near[word] >> 32)
        for word in way.excluded:
            chunks = np.setdiff1d(chunks, _in_chunks(places.get(word, none), chunks) >> 32, assume_unique=False)
        near = {w: _in_chunks(x, chunks) for w, x in near.items()}
        units = [(near[w], 1) for w in dict.fromkeys(way.terms)]
        units += [(reduce(np.intersect1d, [near[w] - i for i, w in enumerate(p)]), len(p)) for p in dict.fromkeys(way.phrases)]
        parts.append(units)
        matched.append(chunks)
    at = np.unique(np.concatenate([starts for units in parts for starts, _ in units] or [none]))
    if not len(at):
        return none, np.zeros(0)
    end = np.full(len(at), _FAR)
    for units in parts:
        end = np.minimum(end, np.max([_ends(starts, length, at) for starts, length in units], axis=0))
    after = np.append(end[1:], _FAR)
    after[:-1][at[1:] >> 32 != at[:-1] >> 32] = _FAR
    cover = (end < _FAR) & (after > end)
    begin, end = at[cover], end[cover]
    chunks = np.unique(np.concatenate(matched))
    every = np.unique(np.concatenate([_in_chunks(places.get(w, none), chunks) for way in ways for w in way.wanted]))
    inside = np.searchsorted(every, end, side="right") - np.searchsorted(every, begin)
    weight = 0.1 / (1 + (end - begin) - (inside - 1))
    found, first = np.unique(begin >> 32, return_index=True)
    return found, np.round(np.add.reduceat(weight, first), PLACES) if len(found) else np.zeros(0)


def _best_rows(chunk_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((chunk_ids, -scores))[:k]
    return chunk_ids[order], scores[order]


# A search over texts.


def lexical_topk(texts: DataFrame, search: str, k: int = 20) -> DataFrame:
    """The k best of chunks (chunk_id, text) for a search, as chunk_id, lexical_score (rounded), rank.

    A search without words matches nothing. Each text is read by itself, in one pass: those that lack a wanted word are left
    out before they are cut into terms, and of the others only the places of the search's words go on. Each task keeps its k
    best, and only these are shuffled; lexical_topk_stored() reads stored postings instead.
    """
    ways = web_search(search)
    words = list(dict.fromkeys(w for way in ways for w in (*way.wanted, *way.excluded)))
    if not ways:
        return _ranked(texts.select("chunk_id", F.lit(0.0).alias("lexical_score")).filter(F.lit(False)), k)
    lower = F.lower("text")
    may = reduce(Column.__or__, (reduce(Column.__and__, (F.contains(lower, F.lit(w)) for w in way.wanted)) for way in ways))
    number = F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, i)))
    placed = F.filter(F.transform(tokens(F.col("text")), lambda term, i: F.struct(number[term].alias("t"), i.alias("pos"))), lambda x: x["t"].isNotNull())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            found = batch["places"]
            flat = found.flatten()
            row = np.repeat(np.arange(len(batch)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            line = row << 32 | flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            term = flat.field("t").to_numpy(zero_copy_only=False)
            rows, new = cover_scores(ways, {w: line[term == i] for i, w in enumerate(words)})
            chunk = batch["chunk_id"].to_numpy(zero_copy_only=False)[rows]
            ids, scores = _best_rows(np.concatenate([ids, chunk]), np.concatenate([scores, new]), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], names=["chunk_id", "lexical_score"])

    rows = texts.filter(may).select(F.col("chunk_id").cast("long").alias("chunk_id"), placed.alias("places"))
    return _ranked(rows.mapInArrow(score, "chunk_id long, lexical_score double"), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = scored.orderBy(F.desc("lexical_score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("lexical_score"), "chunk_id")))


# Stored postings.


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def slice_postings(batches: Iterator[pa.RecordBatch], within: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The blocks of each slice, out of rows (chunk_id, within, slice, terms) that are sorted by slice; one slice is held."""
    keys, held, key = [*within, "slice"], [], None
    for batch in batches:
        rows = [tuple(x) for x in zip(*(batch[k].to_pylist() for k in keys), strict=True)]
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            if first == end:
                continue
            if held and rows[first] != key:
                yield from _blocks(pa.Table.from_batches(held), keys)
                held = []
            key = rows[first]
            part = batch.slice(first, end - first)
            coded = part["terms"].flatten().dictionary_encode()  # a batch's terms are kept once each, as a batch of its own
            lists = pa.array(part["terms"].value_lengths().to_numpy(zero_copy_only=False), pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists.to_numpy())]), pa.int32())
            coded = pa.ListArray.from_arrays(offsets, coded)
            held.append(pa.RecordBatch.from_arrays([part["chunk_id"], *(part[k] for k in keys), coded], names=["chunk_id", *keys, "terms"]))
    if held:
        yield from _blocks(pa.Table.from_batches(held), keys)


def _blocks(rows: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The blocks of one slice, some thousand terms at a time."""
    counts = pc.list_value_length(rows["terms"]).to_numpy()
    chunk = np.repeat(rows["chunk_id"].to_numpy(), counts)
    place = (np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts) + 1).astype(np.int32)
    terms = pc.list_flatten(rows["terms"]).unify_dictionaries().combine_chunks()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.chunk(0)
    term = terms.indices.to_numpy(zero_copy_only=False)
    if not len(term):
        return
    order = np.lexsort((place, chunk, term))
    term, chunk, place = term[order], chunk[order], place[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])
    pair = np.flatnonzero(new)  # where each chunk of each term begins
    sizes = np.diff(np.append(pair, len(term))).astype(np.int32)
    begin = np.flatnonzero(np.append(True, term[pair][1:] != term[pair][:-1]))  # where each term begins, in pairs
    most, n = np.maximum.reduceat(sizes, begin), np.diff(np.append(begin, len(pair)))
    pairs_at, places_at = np.append(begin, len(pair)), np.append(pair[begin], len(term))
    names = terms.dictionary.take(pa.array(term[pair[begin]]))
    for a in range(0, len(begin), TERMS_AT_ONCE):
        b = min(a + TERMS_AT_ONCE, len(begin))
        p, q, x, y = pairs_at[a], pairs_at[b], places_at[a], places_at[b]
        inner = pa.array(pairs_at[a : b + 1] - p, pa.int32())
        columns = [
            *(pa.array(rows[k][:1].to_pylist() * (b - a), rows.schema.field(k).type) for k in keys), names[a:b], pa.array(n[a:b], pa.int32()), pa.array(most[a:b], pa.int32()),
            pa.ListArray.from_arrays(inner, pa.array(chunk[pair[p:q]], pa.int64())), pa.ListArray.from_arrays(inner, pa.array(sizes[p:q], pa.int32())),
            pa.ListArray.from_arrays(pa.array(places_at[a : b + 1] - x, pa.int32()), pa.array(place[x:y], pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "term", "n", "most", "chunks", "sizes", "places"])


def store_postings(texts: DataFrame, path: str, buckets: int = 64, within: Sequence[str] = (), slice_chunks: int = SLICE_CHUNKS) -> DataFrame:
    """Stores the postings of chunks (chunk_id, text, and the columns `within` that searches are held to) in blocks, and
    returns them: bucket (the folder), within, slice, term, n (chunks that have the term), most (that one has of it), chunks,
    sizes (how many each has), and places (from 1, chunk after chunk). Texts are shuffled once, by slice; blocks once more, to
    their folders, where a file has the blocks of some slices by term. Each group of chunks that searches are held to has as
    many slices as its size asks for. Chunks without a term have no postings."""
    spark = texts.sparkSession
    sizes = _stored(texts.groupBy(*within).agg(F.count("*").alias("n")), "sizes")
    groups, n = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / slice_chunks), F.least(F.lit(2 * tasks), F.floor(F.col("n") / LEAST_SLICE)))
    sizes = sizes.select(*(F.col(c).alias(f"of_{c}") for c in within), many.cast("long").alias("slices"))
    same = reduce(Column.__and__, (texts[c].eqNullSafe(sizes[f"of_{c}"]) for c in within), F.lit(True))
    chunk = F.col("chunk_id").cast("long")
    counted = texts.select("chunk_id", *within, "text").join(F.broadcast(sizes) if groups <= BROADCAST_GROUPS else sizes, same)
    sliced = counted.select(chunk.alias("chunk_id"), *within, "text", F.pmod(F.xxhash64(chunk), F.col("slices")).cast("int").alias("slice"))
    sorted_slices = sliced.repartition(*within, "slice").sortWithinPartitions(*within, "slice")
    terms = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("terms")  # texts are shuffled, not their terms
    sorted_slices = sorted_slices.select("chunk_id", *within, "slice", terms)
    kinds = {f.name: f.dataType.simpleString() for f in sliced.schema if f.name in within}
    of = "".join(f"`{c}` {kinds[c]}, " for c in within)
    built = sorted_slices.mapInArrow(lambda batches: slice_postings(batches, within), f"{of}slice int, term string, n int, most int, chunks array<long>, sizes array<int>, places array<int>")
    blocks = built.select(_bucket(F.col("term"), buckets).alias("bucket"), *within, "slice", "term", "n", "most", "chunks", "sizes", "places")
    deals = max(1, n // (64 * slice_chunks))
    dealt = blocks.repartition("bucket", F.pmod(F.xxhash64(*within, "slice"), F.lit(deals)))
    dealt.sortWithinPartitions("bucket", "term", *within, "slice").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def parsed(searches: DataFrame) -> DataFrame:
    """searches (query_id, search, ...) with `ways`, what each asks for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("terms", pa.list_(pa.string())), ("phrases", pa.list_(pa.list_(pa.string()))), ("excluded", pa.list_(pa.string()))]))
        for batch in batches:
            ways = [[{"terms": w.terms, "phrases": w.phrases, "excluded": w.excluded} for w in web_search(s or "")] for s in batch["search"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], names=[*batch.schema.names, "ways"])

    return searches.mapInArrow(parse, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in searches.schema)}, ways {WAYS}")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_bounds(stored: DataFrame, queries: DataFrame, within: Sequence[str], buckets: int) -> DataFrame:
    """(query_id, within, slice, bound): no chunk of the slice scores more than its bound; slices without one match nothing.
    Only the folders of the searches' words are read, and of their blocks only the numbers.

    The covers of a way begin at different occurrences of its parts, and a part has as many as the rarest of its words at
    most. Of single words, each occurrence of the rarest is in as many covers as there are words at most.
    """
    ways = queries.select("query_id", *within, F.posexplode("ways").alias("way", "w"))
    part_words = F.concat(F.transform("w.terms", lambda t: F.array(t)), F.col("w.phrases"))
    parts = ways.select("query_id", *within, "way", (F.size("w.phrases") == 0).alias("single"), F.posexplode(F.array_distinct(part_words)).alias("part", "words"))
    words = _stored(parts.select("query_id", *within, "way", "single", "part", F.explode("words").alias("term")).distinct().withColumn("bucket", _bucket(F.col("term"), buckets)), "search-words")
    folders = [r.bucket for r in words.select("bucket").distinct().collect()]  # at most `buckets`
    blocks = stored.filter(F.col("bucket").isin(folders)).select(*within, "slice", "term", "n", "most")
    key = [*within, "term"]
    totals = blocks.join(words.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.sum("n").alias("total"))
    counted = words.join(totals, key, "left")
    way = ["query_id", *within, "way"]
    rare = counted.groupBy(*way).agg(F.min_by("term", F.struct("total", "term")).alias("term"), F.count_if(F.col("total").isNull()).alias("lacking"), F.count_distinct("term").alias("wanted"))
    rare = _stored(rare.filter("lacking = 0").drop("lacking"), "rarest-words")
    where = rare.join(blocks, key).select(*way, "wanted", "slice")
    found = where.join(words, way).join(blocks, [*key, "slice"]).select(*way, "wanted", "slice", "single", "part", "term", "most")
    per_part = found.groupBy(*way, "wanted", "slice", "single", "part").agg(F.min("most").alias("least"), F.collect_set("term").alias("terms"))
    per_way = per_part.groupBy(*way, "wanted", "slice", "single").agg(
        F.sum("least").alias("starts"), F.min("least").alias("rarest"), F.count("*").alias("parts"), F.size(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("there")
    )
    most = F.when(F.col("single"), F.least(F.col("parts") * F.col("rarest"), F.col("starts") - F.col("parts") + 1)).otherwise(F.col("starts"))
    return per_way.filter("there = wanted").groupBy("query_id", *within, "slice").agg(F.sum(0.1 * most).alias("bound"))


def _pass(stored: DataFrame, pairs: DataFrame, queries: DataFrame, within: Sequence[str], k: int, buckets: int, deals: int) -> DataFrame:
    """The k best chunks of each (query, slice) of pairs."""
    asked = queries.select("query_id", "ways", F.pmod(F.xxhash64("query_id"), F.lit(deals)).alias("deal"))
    work = pairs.select("query_id", *within, "slice").join(asked, "query_id")
    wanted = F.flatten(F.transform("ways", lambda w: F.concat(w["terms"], F.flatten(w["phrases"]), w["excluded"])))
    needed = work.select(*within, "slice", "deal", F.explode(F.array_distinct(wanted)).alias("term")).distinct()
    needed = _stored(needed.withColumn("bucket", _bucket(F.col("term"), buckets)), "needed-blocks")
    folders = [r.bucket for r in needed.select("bucket").distinct().collect()]  # at most `buckets`
    blocks = stored.filter(F.col("bucket").isin(folders)).drop("bucket", "n", "most").join(needed.drop("bucket"), [*within, "slice", "term"])
    key = [*within, "slice", "deal"]

    def score(work: pa.Table, blocks: pa.Table) -> pa.Table:
        chunks = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in blocks["chunks"].combine_chunks()] if blocks.num_rows else []
        ids = np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.int64)
        places = {}
        for term, of, sizes, at in zip(blocks["term"].to_pylist(), chunks, blocks["sizes"], blocks["places"], strict=True):
            row = np.repeat(np.searchsorted(ids, of), sizes.values.to_numpy(zero_copy_only=False))
            places[term] = row.astype(np.int64) << 32 | at.values.to_numpy(zero_copy_only=False).astype(np.int64)
        found: list[tuple] = []
        for query, ways in zip(work["query_id"].to_pylist(), work["ways"].to_pylist(), strict=True):
            ways = [Terms(tuple(w["terms"]), tuple(map(tuple, w["phrases"])), tuple(w["excluded"])) for w in ways]
            rows, scores = cover_scores(ways, places)
            best, scores = _best_rows(ids[rows], scores, k)
            found.append((np.full(len(best), query), best, scores))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "chunk_id": pa.array(columns[1], pa.int64()), "lexical_score": pa.array(columns[2], pa.float64())})

    return work.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(score, "query_id long, chunk_id long, lexical_score double")


def search_stored(stored: DataFrame, queries: DataFrame, k: int = 20, within: Sequence[str] = (), buckets: int = 64, first_slices: int = FIRST_SLICES) -> DataFrame:
    """For each of queries (query_id, ways, and the columns `within`) its k best chunks, as query_id, chunk_id, lexical_score
    (rounded), rank, from what store_postings() has stored with as many buckets. Exact: a slice is left out only if its bound
    is below the k-th best score that other slices give."""
    queries = _stored(queries.select(F.col("query_id").cast("long").alias("query_id"), *within, "ways").filter(F.size("ways") > 0), "searches")
    deals = max(1, -(-queries.count() // SEARCHES_AT_ONCE))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
    bounds = _stored(slice_bounds(stored, queries, within, buckets).withColumn("place", F.row_number().over(order)), "slice-bounds")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "chunk_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    first = _stored(ranked(_pass(stored, bounds.filter(F.col("place") <= first_slices), queries, within, k, buckets, deals)), "first-slices")
    least = first.filter(F.col("rank") == k).select("query_id", F.col("lexical_score").alias("least"))
    rest = bounds.filter(F.col("place") > first_slices).join(least, "query_id", "left")
    rest = _stored(rest.filter(F.col("least").isNull() | (F.col("bound") + 10.0**-PLACES >= F.col("least"))), "other-slices")
    if rest.isEmpty():
        return first
    more = _pass(stored, rest, queries, within, k, buckets, deals)
    return ranked(first.drop("rank").unionByName(more))


def lexical_topk_stored(stored: DataFrame, search: str, k: int = 20, buckets: int = 64) -> DataFrame:
    """lexical_topk() over stored postings."""
    spark: SparkSession = stored.sparkSession
    asked = parsed(spark.createDataFrame([(0, search)], "query_id long, search string"))
    return search_stored(stored, asked, k, buckets=buckets).select("chunk_id", "lexical_score", "rank")
