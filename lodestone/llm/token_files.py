"""Token ids as Arrow files of equal-length sequences (operator 9).

A folder holds, for each range of document ids, one Arrow IPC file of record batches whose rows are sequences:
`ids` is a fixed-size list of `sequence_length` unsigned integers and `mask` a fixed-size list of booleans (false only
in the padding of a file's last sequence). Its footer and the equal lengths give zero-copy access to any sequence. A
second file beside it lists its documents (`doc_id`, `start` within the file, `n_tokens`), and the `manifest` table
lists the files in order with the number of tokens before each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import partitions, steps

SEQUENCE_LENGTH = 2048
#: Bytes of words (and of what keeps them) that a worker process remembers; beyond that it forgets the rarer ones.
REMEMBERED_BYTES = 112 << 20
#: About what a remembered word takes beside its own characters.
WORD_OVERHEAD = 160
#: Words that the tokenizer gets at once, one to a line.
LEARNED_AT_ONCE = 16_384
#: Looking words up costs time for each step, so the steps are longer here.
STEP_BYTES = 6 << 20
MANIFEST = "file string, docs long, tokens long, first_id long"
#: Characters of many kinds, of which all pairs are tried with blanks between them and around them.
PROBES = "a Z 0 9 . , ' \u2019 - _ # < > | \u00e9 e\u0301 \u00df \u0130 \u4e2d \u3042 \u0301 \u00a0 \u2003 \ufeff \U0001f600 \x00".split(" ")


def works_by_words(tokenizer) -> bool:
    """Whether the ids of a text are those of its chunks between spaces and line breaks, one after the other, as far as
    the tokenizer's parts and probes tell: it normalizes by kinds that don't look across blanks, has no added token with
    a blank, and gives a pair of characters the same ids with a blank or line break between them as each alone."""
    parts = json.loads(tokenizer.to_str())
    found = parts["normalizer"]
    normalizers = [] if found is None else found["normalizers"] if found["type"] == "Sequence" else [found]
    plain = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
    white = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if not all(n["type"] in plain or n == white for n in normalizers) or parts["pre_tokenizer"] is None:
        return False
    if any(" " in t["content"] or "\n" in t["content"] for t in parts["added_tokens"]):
        return False
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    alone = {c: ids(c) for c in PROBES}
    return not ids(" \n  ") and all(ids(f" {a}{blank}{b}\n") == alone[a] + alone[b] for a in PROBES for b in PROBES for blank in (" ", "\n"))


class Growing:
    """An array that grows in place, doubling its room."""

    def __init__(self, dtype: type, first: int = 1 << 16) -> None:
        self.room, self.size = np.zeros(first, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            wider = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : end] = values
        self.size = end


class WordEncoder:
    """Encodes texts by their distinct words, each once for as long as it is remembered; whole texts where the tokenizer
    does not work by words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_words = works_by_words(self.tokenizer)
        self.start()

    def start(self) -> None:
        self.numbers: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.starts, self.seen = Growing(self.dtype), Growing(np.int64), Growing(np.int32)
        self.starts.extend(np.zeros(1, np.int64))

    def forget(self) -> None:
        """Forgets the words of a single step, or all if those are few."""
        known, words = np.flatnonzero(self.seen.room[: self.seen.size] > 1), list(self.numbers)
        starts, ids = self.starts.room, self.ids.room
        sizes = starts[known + 1] - starts[known]
        held = ids[np.repeat(starts[known] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        kept = [words[k] for k in known.tolist()]
        self.start()
        size = sum(map(len, kept)) + WORD_OVERHEAD * len(kept)
        if size < REMEMBERED_BYTES // 2:
            self.add(kept, held, np.cumsum(sizes))

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.starts.extend(self.ids.size + ends)
        self.ids.extend(ids)
        self.seen.extend(np.zeros(len(words), np.int32))
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.bytes += sum(map(len, words)) + WORD_OVERHEAD * len(words)

    def learn(self, words: list[str]) -> None:
        """Adds the ids of words without a space or a line break. The tokenizer takes many as lines of one text; an id
        belongs to the line in which its characters begin."""
        for first in range(0, len(words), LEARNED_AT_ONCE):
            some = words[first : first + LEARNED_AT_ONCE]
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ids = np.fromiter(found.ids, self.dtype, len(found.ids))
            begin = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids))[::2]
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            self.add(some, ids, np.searchsorted(begin, ends))

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has (a null text: none)."""
        if not self.by_words:
            found = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), self.dtype, int(counts.sum())), counts
        filled = pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks()
        if isinstance(filled, pa.ChunkedArray):
            filled = pa.concat_arrays(filled.chunks)
        chunks = pc.split_pattern(pc.replace_substring(filled, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct.cast(pa.string())), "\n")
        words = joined[0].as_py().split("\n") if len(distinct) else []
        if self.bytes > REMEMBERED_BYTES:
            self.forget()
        known = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(known < 0)
        known[fresh] = len(self.numbers) + np.arange(len(fresh))
        self.learn([words[k] for k in fresh.tolist()])
        self.seen.room[known] += 1
        starts, of = self.starts.room, coded.indices.to_numpy(zero_copy_only=False)
        sizes = (starts[known + 1] - starts[known]).astype(np.int32)
        counts = sizes[of]
        ends = np.cumsum(counts, dtype=np.int64)
        where = np.repeat(starts[known][of] - (ends - counts), counts)
        where += np.arange(len(where))
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))])]
        return self.ids.room[where], np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SequenceFile:
    """Writes a run of ids as equal-length sequences, holding less than a batch of them."""

    BATCH = 256

    def __init__(self, sink: pa.NativeFile, length: int, dtype: np.dtype) -> None:
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.length, self.held, self.dtype = pa.ipc.new_file(sink, self.schema), length, [], dtype
        self.size = 0

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        self.held.append(ids.astype(self.dtype, copy=False))
        self.size += len(ids)
        if not last and self.size < self.BATCH * self.length:
            return
        flat = np.concatenate(self.held)
        end = len(flat) // self.length * self.length
        self.put(flat[:end], end)
        rest = flat[end:]
        if last:
            if len(rest):
                self.put(np.concatenate([rest, np.zeros(self.length - len(rest), self.dtype)]), len(rest))
            self.writer.close()
            rest = rest[:0]
        self.held, self.size = [rest], len(rest)

    def put(self, flat: np.ndarray, real: int) -> None:
        for at in range(0, len(flat), self.BATCH * self.length):
            part = flat[at : at + self.BATCH * self.length]
            mask = np.arange(at, at + len(part)) < real
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, sequence_length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Writes the token ids of docs (doc_id, text) under `path` in ascending doc_id order; returns the manifest.

    doc_id must be a number. Null and empty texts have the end id alone. Rows with one doc_id stand together, by text. Other columns are not
    read. An empty table gives an empty manifest. A retried task writes the same files under the same names; each file
    gets its name only when it is complete.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        files, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        ours = f"{folder}/_{name}.{task.taskAttemptId()}"
        sink = sequences = None
        ids_of, counts_of = [], []
        for table in steps(batches, limit=STEP_BYTES):
            if sink is None:
                files.create_dir(folder, recursive=True)
                sink = files.open_output_stream(ours)
                sequences = SequenceFile(sink, sequence_length, words.dtype)
            ids, counts = words.encode(table["text"])
            sequences.add(np.insert(ids, np.cumsum(counts), end_id))
            ids_of += table["doc_id"].to_pylist()
            counts_of.append(counts + 1)
        if sink is None:
            return
        sequences.add(np.zeros(0, words.dtype), last=True)
        sink.close()
        counts = np.concatenate(counts_of)
        index = pa.table(
            {"doc_id": pa.array(ids_of, pa.int64()), "start": np.cumsum(counts) - counts, "n_tokens": counts}
        )
        with files.open_output_stream(f"{ours}.docs") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)
        files.move(f"{ours}.docs", f"{folder}/{name}.docs.arrow")
        files.move(ours, f"{folder}/{name}.arrow")
        row = {"file": [name], "docs": [len(ids_of)], "tokens": [int(counts.sum())], "first_id": [ids_of[0]]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files of `path`: doc_id, start (ids before it in the whole set), n_tokens, and
    its ids as little-endian unsigned 32-bit integers (binary), taken from the sequences where the mask is true."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{name}.docs.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                yield from documents(files, f"{folder}/{name}.arrow", index, first)

    return placed.repartition(partitions(spark)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def documents(files: fs.FileSystem, file: str, index: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, a record batch of its sequences at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    starts, counts = index["start"].to_numpy(), index["n_tokens"].to_numpy()
    with files.open_input_file(file) as source:
        reader = pa.ipc.open_file(source)
        held, held_at, row = np.zeros(0, np.uint32), 0, 0
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            flat, mask = batch.column(0).flatten(), batch.column(1).flatten()
            real = flat.to_numpy()[mask.to_numpy(zero_copy_only=False)].astype("<u4")
            held = np.concatenate([held, real])
            end = np.searchsorted(starts + counts, held_at + len(held), side="right")
            if end > row:
                cut = [held[a : a + n].tobytes() for a, n in zip(starts[row:end] - held_at, counts[row:end], strict=True)]
                yield pa.record_batch([index["doc_id"].slice(row, end - row).combine_chunks(), pa.array(starts[row:end] + first), pa.array(counts[row:end]), pa.array(cut, pa.binary())], schema=schema)
                used = starts[end] - held_at if end < len(starts) else len(held)
                held, held_at, row = held[used:], held_at + int(used), int(end)


