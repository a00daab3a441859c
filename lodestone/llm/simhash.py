"""SimHash near-duplicates by meeting in the middle of a ball (operator 12).

A text's fingerprint has a bit for each of 64 places, set if more than half of its shingles' hashes have it. Two
fingerprints are linked if they differ in at most RADIUS bits. Both then lie within half the radius of some common word of
64 bits, so each distinct fingerprint emits every variant within half the radius (itself and its 64 neighbours), the
variants are shuffled, and fingerprints that meet at one are paired, the pairs freed of repeats and verified.

Texts with one fingerprint are one row before anything is emitted, so a group of copies of any size costs 65 variants, and
at most 65 distinct fingerprints can meet at one variant. No bucket has a cap, and none needs one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import components, hot_join, hot_keys
from lodestone.llm.shared import steps, unused, written

SHINGLE = 3
BITS = 64
#: Bits by which linked fingerprints differ at most; variants are within half of it, so it must be 2 (or 3) here.
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8: words between ASCII white space, A-Z in lower case; shingles of SHINGLE words
    with their repeats, or all words where there are fewer; 0 where there is none."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = max(0, len(words) - SHINGLE)
    begins, stops = [0, *ends[:last]], [e - 1 for e in ends[len(words) - 1 - last :]]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last + 1, AT_ONCE):
        spans = map(slice, begins[at : at + AT_ONCE], stops[at : at + AT_ONCE])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last + 1).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint`, a long of 64 bits. A null, empty or blank text has 0. Other columns stay, whatever their
    names; an older `fingerprint`, in any case, is replaced."""
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    key, rest = unused(docs.columns, "_text"), unused(docs.columns, "_rest")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, key):
            found = [fingerprint(t.encode() if t else b"") for t in table[key].to_pylist()]
            values = pa.chunked_array([pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())])
            whole = pa.table({rest: table[rest], "fingerprint": values})
            yield from whole.to_batches()

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(rest), F.col("text").alias(key))
    out = packed.mapInArrow(described, packed.select(rest, F.lit(0).cast("long").alias("fingerprint")).schema)
    return out.select(f"{rest}.*", "fingerprint")


def variants(prints: DataFrame) -> DataFrame:
    """(variant, fingerprint) for every word of 64 bits within half the radius of each of the distinct fingerprints."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)))
    return prints.select("fingerprint", F.explode(flips).alias("flip")).select(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("variant"), "fingerprint")


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b, distance), a < b, for all pairs of the distinct fingerprints that differ in at most RADIUS bits. A fingerprint
    has at most 2,080 such partners, whatever the table's size."""
    met = written(variants(prints), "variants")
    left, right = met.withColumnRenamed("fingerprint", "a"), met.withColumnRenamed("fingerprint", "b")
    pairs = left.join(right, "variant").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).filter(F.col("distance") <= RADIUS)


def near_chains(prints: DataFrame) -> DataFrame:
    """(a, b): at each variant, the least fingerprint with each other one, verified and without repeats. No more pairs than
    near_pairs() has, found by one pass over the sorted variants, with the same connected components."""
    least = F.first("fingerprint").over(Window.partitionBy("variant").orderBy("fingerprint"))
    met = variants(prints).select(least.alias("a"), F.col("fingerprint").alias("b")).filter("a <> b")
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of docs (doc_id, text): the least doc_id that can be reached
    over links, its own included. Null doc_ids are never the least; where a component has no other, its id is null. Rows
    that repeat stay, as copies of each other; other columns are not read; an empty table gives none."""
    found = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "fingerprints")
    prints = written(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_chains(prints.select("fingerprint")))
    linked = written(prints.join(roots, prints["fingerprint"] == roots["node"]).select("fingerprint", "first", "root"), "linked-fingerprints")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = hot_join(linked, least, "root", hot=hot_keys(linked, "root")).select("fingerprint", "least")
    alone = prints.join(named, "fingerprint", "left_anti").select("fingerprint", F.col("first").alias("least"))
    return hot_join(found, named.unionByName(alone), "fingerprint", hot=hot_keys(found, "fingerprint")).select("doc_id", "fingerprint", F.col("least").alias("component_id"))
