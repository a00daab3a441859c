"""Substring deduplication (operator 1) by difference-cover anchors.

A window is a run of LENGTH words. Only runs of ANCHOR words that begin at places in a difference cover modulo PERIOD
are hashed at first. For any two places there is a shift below PERIOD that brings both into the cover, and PERIOD - 1 +
ANCHOR = LENGTH, so any two equal windows have an equal anchor at the same shift inside them. Windows around repeated
anchors are then compared whole, by 96 bits: first those that begin at a repeated anchor, which settle the inside of
long matches, then every other window that could still remove a word.

Each of the three rounds counts hashes in the same way. A task first compares what it holds itself, so that it sends a
hash once however often it has it, and a hash that is everywhere costs its reducer one entry for each task. Hashes are
dealt out in packed buckets, a small fixed share of all to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rolling import Words, mixed
from lodestone.llm.shared import beside, partitions, steps, unused

LENGTH = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # the differences of its members give every residue modulo 21
ANCHOR = LENGTH - PERIOD + 1
#: Hashes that a task gathers before it compares them among themselves.
GATHERED = 1_000_000
#: A row: what a task sends of the hashes in one bucket. a, b: their two parts (b is empty where one does); key, at: the
#: documents and places of those that ask whether theirs occurs again, which come first in a and b (the others only make
#: hashes occur more than once); done_key, done_at: the documents and places that the task has answered itself.
ROWS = "bucket int, a binary, b binary, key binary, at binary, done_key binary, done_at binary"
#: Buckets for each shuffle partition.
BUCKETS = 2
#: Names of the columns that the rounds work with.
OWN = ("_key", "_repeated", "_known", "_more", "_cut")

#: Places among the words of a step, the two parts of their hashes, and whether an answer is needed.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def covered(starts: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """Which of n words a window from one of the starts covers."""
    change = np.zeros(n + length + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change)[:n] > 0


def marked(table: pa.Table, column: str, words: Words) -> np.ndarray:
    """The places of all texts in a column of lists, as places among all words of the step."""
    lists = table[column].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    counts = np.nan_to_num(pd.to_numeric(lists.value_lengths().to_pandas())).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.starts[:-1], counts)


def anchors(table: pa.Table, words: Words) -> Found:
    """Round 1: the anchors at cover places of texts that have a window."""
    of, place = words.places()
    n = np.diff(words.starts)[of]
    chosen = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + ANCHOR <= n) & (n >= LENGTH))
    return chosen, words.runs(ANCHOR)[chosen], np.zeros(len(chosen), np.uint32), np.ones(len(chosen), bool)


def windows(at: np.ndarray, asked: np.ndarray, words: Words) -> Found:
    return at, words.runs(LENGTH)[at], (words.runs(LENGTH, seed=3)[at] >> np.uint64(32)).astype(np.uint32), asked


def aligned(table: pa.Table, words: Words) -> Found:
    """Round 2: the windows that begin at repeated anchors."""
    at = marked(table, "_repeated", words)
    of, place = words.places()
    at = at[place[at] + LENGTH <= np.diff(words.starts)[of[at]]]
    return windows(at, np.ones(len(at), bool), words)


def others(table: pa.Table, words: Words) -> Found:
    """Round 3: all windows with a repeated anchor in their first PERIOD places. Those that what is known covers wholly
    have nothing to ask, but are equal to others that may."""
    of, place = words.places()
    total = len(of)
    near = np.zeros(total + PERIOD + 1, np.int32)
    anchored = np.zeros(total, bool)
    anchored[marked(table, "_repeated", words)] = True
    near[1 : total + 1] = np.cumsum(anchored)
    near[total + 1 :] = near[total]
    bare = np.zeros(total + LENGTH + 1, np.int32)
    bare[1 : total + 1] = np.cumsum(~covered(marked(table, "_known", words), total))
    bare[total + 1 :] = bare[total]
    here = np.arange(total)
    fits = place + LENGTH <= np.diff(words.starts)[of] if total else np.zeros(0, bool)
    at = np.flatnonzero(fits & (near[here + PERIOD] > near[here]))
    return windows(at, bare[at + LENGTH] > bare[at], words)


def packed(held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Compares hashes within the task. One goes on for those that it has more than once, and all that asked have their
    answer; these are spread over the buckets, so that a hash that is everywhere fills none."""
    a, b, asked, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
    two = bool(b.any())
    order = np.lexsort((b, a)) if two else np.argsort(a)
    a, b, asked, key, at = a[order], b[order], asked[order], key[order], at[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    many = np.diff(np.append(np.flatnonzero(new), len(a)))[np.cumsum(new) - 1] > 1
    over = many & asked
    done_key, done_at = key[over], at[over]
    a, b, asked, key, at = a[new], b[new], (asked & ~many)[new], key[new], at[new]
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, ~asked, bucket))
    a, b, asked, key, at, bucket = a[order], b[order], asked[order], key[order], at[order], bucket[order]
    done = (mixed(done_key.view(np.uint64) + done_at.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((done_key, done))
    done_key, done_at = done_key[order], done_at[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    asks = np.concatenate([[0], np.cumsum(asked)])
    done_ends = np.searchsorted(done[order], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        x, y, u, v = ends[k], ends[k + 1], done_ends[k], done_ends[k + 1]
        if y > x or v > u:
            z = x + asks[y] - asks[x]
            rows.append((k, a[x:y].tobytes(), b[x:y].tobytes() if two else b"", key[x:z].tobytes(), at[x:z].tobytes(), done_key[u:v].tobytes(), done_at[u:v].tobytes()))
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 6
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def gathered(pick: Callable, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in steps(batches):
            words = Words(table["text"])
            found, a, b, asked = pick(table, words)
            of, place = words.places()
            keys = table["_key"].to_numpy().astype(np.int64)[of[found]]
            held.append((a, b, asked, keys, place[found].astype(np.int32)))
            size += len(found)
            if size >= GATHERED:
                yield from packed(held, buckets)
                held, size = [], 0
        if held:
            yield from packed(held, buckets)

    return run


def answered(table: pa.Table) -> pa.Table:
    """The documents and places of a bucket whose hashes occur more than once."""
    flat = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    a, b, key, at = flat("a", np.uint64), flat("b", np.uint32), flat("key", np.int64), flat("at", np.int32)
    b = b if len(b) else np.zeros(len(a), np.uint32)
    sizes = np.array([len(x) // 8 for x in table["a"].to_pylist()], np.int64)
    asks = np.array([len(x) // 8 for x in table["key"].to_pylist()], np.int64)
    asking = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(asks) - asks), asks) + np.arange(int(asks.sum()))
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    again = np.zeros(len(a), bool)
    again[order] = np.diff(np.append(np.flatnonzero(new), len(a)))[np.cumsum(new) - 1] > 1
    yes = again[asking]
    keys, places = np.concatenate([key[yes], flat("done_key", np.int64)]), np.concatenate([at[yes], flat("done_at", np.int32)])
    return pa.table({"_key": keys, "at": places})


def repeats(rows: DataFrame, pick: Callable, name: str) -> DataFrame:
    """(_key, <name>: list of places) of what `pick` hashes in rows and what occurs more than once."""
    buckets = BUCKETS * partitions(rows.sparkSession)
    sent = rows.mapInArrow(gathered(pick, buckets), ROWS)
    places = sent.groupBy("bucket").applyInArrow(answered, "_key long, at int")
    return places.groupBy("_key").agg(F.collect_list("at").alias(name))


def row_key(columns: list[str]) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns if c in ("doc_id", "text")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept_text, without the words that a repeated window of LENGTH words covers.

    Windows are judged on the input, so every copy of a passage goes, and one that overlaps itself too. kept_text has the
    words that stay, joined by one space. A null or empty text has no words and an empty kept_text; texts under LENGTH
    words keep all. Repeated rows are copies of each other, and all go. Ties don't occur, as every repeat goes. Very long
    texts are taken whole, a text at a time. An empty table gives an empty one. Other columns stay, whatever their names;
    older ones of these three are replaced.
    """
    new = ("n_words", "n_removed", "kept_text")
    own = beside(docs.columns, *new)
    # Columns that are named like ours take other names for a while. They stay columns: a struct of them would be taken
    # apart by the optimizer in some rounds and not in others, which then had to shuffle the texts twice.
    away = {c: unused([*own, *OWN], c) if c.lower() in OWN else c for c in own}
    rows = docs.select(*(F.col(f"`{c}`").alias(away[c]) for c in own), row_key(own).alias("_key"))
    rows = rows.repartition(partitions(docs.sparkSession), "_key")
    # All rounds read the same columns, so that they share one shuffle of the texts.
    repeated = repeats(rows, anchors, "_repeated")
    known = repeats(rows.join(repeated, "_key"), aligned, "_known")
    more = repeats(rows.join(repeated, "_key").join(known, "_key", "left"), others, "_more")
    found = rows.join(known, "_key", "left").join(more, "_key", "left")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        out = []
        for text, *places in zip(texts, first, second, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            at = [np.asarray(p, np.int64) for p in places if p is not None]
            n = len(words)
            if at:
                gone = covered(np.unique(np.concatenate(at)), n).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=list(new))

    keep = [F.col(f"`{away[c]}`") for c in own]
    cut_rows = found.select(*keep, cut("text", "_known", "_more").alias("_cut"))
    return cut_rows.select(*(F.col(f"`{away[c]}`").alias(c) for c in own), "_cut.*")
