"""Document fingerprints (operator 6): sketches of shingle hashes below a fixed fraction of the hash range.

Because the threshold is the same for every text, sketches can be merged by union, and they estimate both likeness and
containment, however unequal two texts are. A short text may have no hash below the threshold. Its least hash is then
kept beside the empty sketch, as a last resort for telling such texts apart; it never enters a sketch. Everything is
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import beside, partitions, written

SHINGLE = 5
#: The retained share of all hashes is 1 / SCALE, unless another scale is given. Sketches of different scales can't be
#: compared; a larger one makes smaller sketches and coarser estimates.
SCALE = 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of all runs of five words; of the whole text if it has one to four; none without a word."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    few = F.when(n > 0, F.array(F.xxhash64(F.lit("few"), F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= SHINGLE, runs).otherwise(few)


def limit(scale: int = SCALE) -> int:
    return -(1 << 63) + (1 << 64) // scale


def retained(hashes: Column, scale: int = SCALE) -> Column:
    """Those below the threshold, ascending."""
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < limit(scale))))


def as_text(sketch: Column, least: Column) -> Column:
    """A sketch in hexadecimal; a text without a hash below the threshold shows its least one, behind a mark."""
    shown = F.lower(F.array_join(F.transform(sketch, F.hex), " "))
    return F.when((F.size(sketch) == 0) & least.isNotNull(), F.concat(F.lit("~"), F.lower(F.hex(least)))).otherwise(shown)


def likeness(a: Column, b: Column, least_a: Column, least_b: Column) -> Column:
    """Estimated Jaccard similarity of two texts. Where neither has a hash below the threshold, 1 if their least hashes are
    equal (or both have no words), else 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, least_a.eqNullSafe(least_b).cast("double")).otherwise(both.cast("double") / either)


def containment(a: Column, b: Column, least_a: Column) -> Column:
    """The estimated share of a's shingles that b has; 1 for a text without words, null (no estimate) for one that has
    words but no hash below the threshold."""
    share = F.size(F.array_intersect(a, b)).cast("double") / F.nullif(F.size(a), F.lit(0))
    return F.when(least_a.isNull(), 1.0).otherwise(share)


def merged(a: Column, b: Column) -> Column:
    """The sketch of the two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def sketches(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """docs with `sketch` (ascending array of longs) and `least` (the least hash of all) of the whole `text`.

    A null text has an empty sketch and a null least, as has one without words. Older columns of these names are
    replaced, and those named _words and _hashes.
    """
    keep = [F.col(f"`{c}`") for c in beside(docs.columns, "_words", "_hashes", "sketch", "least")]
    split = docs.select(*keep, words_of(F.col("text")).alias("_words"))
    hashed = split.select(*keep, shingle_hashes(F.col("_words")).alias("_hashes"))
    return hashed.select(*keep, retained(F.col("_hashes"), scale).alias("sketch"), F.array_min("_hashes").alias("least"))


def place_among(cuts: Column, key: Column) -> Column:
    """How many of the cuts are at most key."""
    return F.size(F.filter(cuts, lambda c: c <= key))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with next_<column> of the row that follows in ascending doc_id order, the first following the last.

    No task sees the whole order. Ids are cut into coarse ranges at approximate quantiles, and those in the same way into
    fine ones, so that a digest never has more cuts than the root of their number and no row is held against more. The
    row that opens a fine range also goes to the one before it (the first row of all: to the last). A null id sorts
    first; rows with equal ids go by the first of `columns` and stand in one range; rows that are equal in that too go
    in any order.
    """
    side = max(2, math.ceil(math.sqrt(2 * partitions(rows.sparkSession))))
    shares, accuracy = [k / side for k in range(1, side)], F.lit(100 * side)
    keyed = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    found = keyed.agg(F.min("_key").alias("least"), F.percentile_approx("_key", shares, accuracy).alias("cuts")).first()
    if found.least is None:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    coarse = place_among(F.lit(sorted(set(found.cuts))), F.col("_key"))
    # At most `side` rows of `side` keys, each the least of a fine range; what the coarse cuts leave empty has none.
    inner = keyed.groupBy(coarse.alias("_coarse")).agg(F.min("_key").alias("_first"), F.percentile_approx("_key", shares, accuracy).alias("_cuts"))
    inner = inner.select("_coarse", F.sort_array(F.array_union(F.array("_first"), F.col("_cuts"))).alias("_cuts"))
    order = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)  # a row a coarse range
    inner = written(inner.withColumn("_before", F.coalesce(F.sum(F.size("_cuts")).over(order), F.lit(0)).cast("int")), "fingerprint-cuts")
    last = inner.agg(F.sum(F.size("_cuts"))).first()[0] - 1
    placed = keyed.withColumn("_coarse", coarse).join(F.broadcast(inner), "_coarse")
    placed = placed.withColumn("_own", F.col("_before") + place_among(F.col("_cuts"), F.col("_key")) - 1)
    copy = lambda at, wrap, guard: F.struct(at.cast("int").alias("at"), F.lit(wrap).alias("wrap"), F.lit(guard).alias("guard"))
    here, none = copy(F.col("_own"), 0, False), F.array().cast("array<struct<at:int,wrap:int,guard:boolean>>")
    opens = F.when(F.array_contains("_cuts", F.col("_key")) & (F.col("_own") > 0), F.array(copy(F.col("_own") - 1, 0, True))).otherwise(none)
    first = F.when(F.col("_key") == found.least, F.array(copy(F.lit(last), 1, True))).otherwise(none)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    spread = placed.select(*kept, "_key", F.explode(F.concat(F.array(here), opens, first)).alias("_copy"))
    order = Window.partitionBy("_copy.at").orderBy("_copy.wrap", "_key", columns[0])
    led = spread.select(*kept, "_copy", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.filter(~F.col("_copy.guard")).drop("_copy")


def edited(text: Column, following: Column) -> Column:
    """text whose last half (rounded down) gives way to the first as many code points of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edited_contained.

    Reads doc_id, which must be a number, and text alone, so other columns don't matter. Null texts count as empty, repeated rows each stand for
    themselves, very long texts are taken whole, and an empty table gives an empty one. edited_contained is null where
    the text is too short for an estimate.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(sketches(plain, scale), ["text", "sketch", "least"])
    own = [F.col("sketch").alias("own"), F.col("least").alias("own_least"), "next_sketch", "next_least"]
    changed = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("text"), *own)
    both = sketches(changed, scale)
    c = F.col
    return both.select(
        "doc_id", "n_chars", F.sha2(c("text").cast("binary"), 256).alias("edited_sha256"), as_text(c("own"), c("own_least")).alias("fingerprint"),
        as_text(c("sketch"), c("least")).alias("edited_fingerprint"), likeness(c("own"), c("sketch"), c("own_least"), c("least")).alias("near_edited"),
        likeness(c("own"), c("next_sketch"), c("own_least"), c("next_least")).alias("near_next"), containment(c("own"), c("sketch"), c("own_least")).alias("edited_contained"),
    )
