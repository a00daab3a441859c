"""Cross-tokenizer alignment (operator 11).

A byte-level tokenizer A reads space + text, a piece tokenizer B reads the text (and puts the space before it itself), so
the tokens of both cover the same bytes. Where tokens of both end at one byte, a group ends. The ends are compared by
diagonal run skipping: from a place where both stand at the same byte, exponentially growing stretches of the two end
arrays are compared at the current shift between their indices, so that one-to-one stretches are jumped; where they part,
the group is resolved token by token up to the next common end, and the shift is what it then is.

A text is cut before a blank or a line break between two characters that aren't white space: neither tokenizer joins
anything across such a place (probes make sure), so each distinct chunk is encoded and aligned once for as long as a worker
remembers it, all new chunks of a step as one pair of arrays, and a document's groups are those of its chunks.

How many documents hold a pair of ids linked is counted over the whole corpus. Documents are written in buckets of about
BUCKET_BYTES of text; a bucket asks for each of its distinct pairs once, however many documents hold it, and the answers
are joined with the bucket's documents. So no pair is hot, and nothing that grows with the corpus is sent to all.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import steps, written
from lodestone.llm.token_files import PROBES, Growing

BUCKET_BYTES = 16 << 20
STEP_BYTES = 2 << 20
#: Bytes of chunks, and what belongs to them, that a worker process remembers before it starts anew.
REMEMBERED_BYTES = 96 << 20
#: Chunks that the tokenizers get as one line, and lines that are encoded and aligned at once.
LINE, LINES_AT_ONCE = 256, 64
#: About what a chunk takes beside its characters and groups.
CHUNK_OVERHEAD = 260
#: Links of one group above which its distinct ids are counted before they are paired.
LARGE_GROUP = 4096
#: Tokens compared one to one at first, after a group that wasn't.
FIRST_PROBE = 2
BLANK = "▁"


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """For two ascending lists of ends with the same last end: the numbers of tokens of each up to every common end."""
    upto_a: list[int] = []
    upto_b: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        probe = FIRST_PROBE
        while i < n and j < m:
            size = min(probe, n - i, m - j)
            if a[i : i + size] != b[j : j + size]:
                break
            upto_a += range(i + 1, i + size + 1)
            upto_b += range(j + 1, j + size + 1)
            i, j, probe = i + size, j + size, 2 * probe
        else:
            break
        low, high = 0, size  # the first `low` ends are equal, the first `high` are not
        while high - low > 1:
            mid = (low + high) // 2
            if a[i + low : i + mid] == b[j + low : j + mid]:
                low = mid
            else:
                high = mid
        upto_a += range(i + 1, i + low + 1)
        upto_b += range(j + 1, j + low + 1)
        i, j = i + low, j + low
        while a[i] != b[j]:
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = i + 1, j + 1
        upto_a.append(i)
        upto_b.append(j)
    return upto_a, upto_b


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow
    from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte = Tokenizer.from_file(byte_path)
        self.byte.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        values = byte_values()
        vocabulary = self.byte.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        pieces = map(self.piece.id_to_piece, range(self.piece.get_piece_size()))
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.piece.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        ids = [f"{k}{x}" for n, both in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for k in range(n) for x in both]
        self.names = pa.array(ids, pa.string())  # each id with what may follow it
        self.pair = np.dtype(np.uint32 if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else np.uint64)
        self.cuts_hold = self.work_by_chunks()

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids by A and B of chunks that begin with a blank or, inside a text, a line break."""
        a = [e.ids for e in self.byte.encode_batch(chunks, add_special_tokens=False)]
        b = self.piece.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return a, [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]

    def encode_lines(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids by A and B of many chunks laid end to end in lines, each beginning with a blank. None where the tokens don't
        give the lines back."""
        texts = [x.decode() for x in lines]
        a = [e.ids for e in self.byte.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.piece.encode([x[1:] for x in texts], num_threads=1)
        a, b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        if not b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(lines) == b"".join(map(self.bytes_b.__getitem__, b)):
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def encode_apart(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for any chunks; one that isn't valid has no ids."""
        a, b = self.encode([c.decode() for c in chunks])
        valid = [b"".join(map(self.bytes_a.__getitem__, x)) == c == b"".join(map(self.bytes_b.__getitem__, y)) for c, x, y in zip(chunks, a, b, strict=True)]
        a, b = (np.fromiter(chain.from_iterable(x for x, ok in zip(ids, valid, strict=True) if ok), np.int64) for ids in (a, b))
        return a, b, np.array(valid, bool)

    def work_by_chunks(self) -> bool:
        """Whether both encode a text as they encode its chunks, as far as their pieces and pairs of probes tell."""
        pieces = [self.piece.id_to_piece(k) for k in range(len(self.bytes_b))]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            return False
        seen = [p for p in PROBES if not p.isspace() and p != BLANK]
        whole = [f" {x}{cut}{y}" for x in seen for y in seen for cut in " \n"]
        parts = [c for x in seen for y in seen for cut in " \n" for c in (f" {x}", f"{cut}{y}")]
        return all(both == [p + q for p, q in zip(each[::2], each[1::2], strict=True)] for both, each in zip(self.encode(whole), self.encode(parts), strict=True))


#: ASCII white space (of Python, which has more than the tokenizers), and what the other white space may end in.
WHITE = frozenset([*range(9, 14), *range(28, 33)])
LAST_OF_WHITE = frozenset([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
#: Last two or three bytes of UTF-8's white space above ASCII: U+85, U+A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000.
WIDE_SPACE = [0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]


def chunk_starts(data: np.ndarray, starts: np.ndarray, cuts: bool) -> np.ndarray:
    """Where chunks begin in texts laid end to end, each with a blank before it."""
    if not cuts or len(data) < 4:
        return starts
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 2) & (at < len(data) - 1)]
    space = np.zeros(256, bool)
    space[list(WHITE)] = True
    may_end = np.zeros(256, bool)
    may_end[list(LAST_OF_WHITE)] = True

    def wide(last: np.ndarray) -> np.ndarray:
        """Whether white space above ASCII ends with the byte at `last`."""
        found = np.zeros(len(last), bool)
        maybe = np.flatnonzero(may_end[data[last]])
        end = last[maybe]
        two = data[end - 1].astype(np.int64) << 8 | data[end]
        three = data[end - 2].astype(np.int64) << 16 | two
        found[maybe] = np.logical_or.reduce([(two == x) | (three == x) for x in WIDE_SPACE])
        return found

    inside = np.ones(len(at), bool)
    inside[np.searchsorted(at, starts[(starts > 2) & (starts < len(data) - 1)])] = False  # a text's own first blank
    at = at[inside & ~space[data[at - 1]] & ~space[data[at + 1]]]
    at = at[~wide(at - 1)]
    after = data[at + 1]
    unsure = np.flatnonzero(after >= 0xC2)
    size = np.where(after[unsure] < 0xE0, 2, 3)
    bad = wide(np.minimum(at[unsure] + size, len(data) - 1))
    keep = np.ones(len(at), bool)
    keep[unsure[bad]] = False
    at = at[keep]
    return np.sort(np.concatenate([at, starts]))


class Aligner:
    """Aligns texts by their chunks."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.both = Tokenizers(byte_path, piece_path)
        self.start()

    def start(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.bytes = 0
        self.counts = [Growing(np.int64) for _ in range(4)]  # tokens of A and B, groups, links
        self.valid = Growing(bool)
        self.pairs, self.times, self.starts = Growing(self.both.pair), Growing(np.int64), Growing(np.int64)
        self.starts.extend(np.zeros(1, np.int64))

    def learn(self, chunks: list[bytes]) -> None:
        """Remembers chunks. Those that neither begin nor end with white space beside the cut are encoded as lines of many, the
        others, and those that a tokenizer doesn't give back, one by one."""
        blank, line_break, odd = [], [], []
        for c in chunks:
            if len(c) < 2 or c[1] in WHITE or c[-1] in WHITE or c[-1] in LAST_OF_WHITE and c[-3:].decode(errors="ignore")[-1:].isspace():
                odd.append(c)
            else:
                (blank if c[0] == 32 else line_break).append(c)
        plain = blank + line_break
        many = -(-len(plain) // LINE) if self.both.cuts_hold else 0
        if many > len(blank) or not many:
            odd, plain = plain + odd, []
        for k in range(0, many if plain else 0, LINES_AT_ONCE):
            lines = [plain[x::many] for x in range(k, min(k + LINES_AT_ONCE, many))]
            some = list(chain.from_iterable(lines))
            found = self.both.encode_lines(list(map(b"".join, lines)))
            self.add(some, *((*found, np.ones(len(some), bool)) if found else self.both.encode_apart(some)))
        if odd:
            self.add(odd, *self.both.encode_apart(odd))

    def add(self, chunks: list[bytes], a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> None:
        """Aligns chunks, all as one pair of arrays, and remembers what is known of each."""
        n = len(chunks)
        ends_a, ends_b = np.cumsum(self.both.lengths_a[a]), np.cumsum(self.both.lengths_b[b])
        upto_a, upto_b = (np.array(x, np.int64) for x in align(ends_a.tolist(), ends_b.tolist()))
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        chunk_ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, n) * valid)
        group_ends = np.searchsorted(ends_a[upto_a - 1], chunk_ends, side="right")
        chunk_of = np.repeat(np.arange(n), np.diff(group_ends, prepend=0))
        of, pair, times = self.links(a, b, upto_a - size_a, upto_b - size_b, size_a, size_b, chunk_of)
        texts = self.group_texts(a, b, upto_a, upto_b, size_a, size_b, group_ends)
        links = np.bincount(chunk_of, size_a * size_b, minlength=n).astype(np.int64)
        tokens = (np.diff(np.searchsorted(ends, chunk_ends, side="right"), prepend=0) for ends in (ends_a, ends_b))
        for kept, new in zip(self.counts, (*tokens, np.diff(group_ends, prepend=0), links), strict=True):
            kept.extend(new)
        self.valid.extend(valid)
        self.starts.extend(self.pairs.size + np.searchsorted(of, np.arange(n), side="right"))
        self.pairs.extend(pair)
        self.times.extend(times)
        self.groups += texts
        self.numbers.update(zip(chunks, range(len(self.numbers), len(self.numbers) + n), strict=True))
        self.bytes += int(chunk_ends[-1]) + sum(map(len, texts)) + CHUNK_OVERHEAD * n + 16 * len(pair)

    def group_texts(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, group_ends: np.ndarray) -> list[str]:
        """The groups of each chunk as `a1,a2|b1;a3|b2,b3;`: every id with what follows it, A's before B's in each group."""
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1] = last_b[upto_b - 1] = 1
        order[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(upto_a, size_b)] = 2 * (b + len(self.both.bytes_a)) + last_b
        tokens = np.concatenate([[0], upto_a + upto_b])[np.concatenate([[0], group_ends])]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), self.both.names.take(pa.array(order))), "").to_pylist()

    def links(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, chunk: np.ndarray) -> tuple:
        """(chunk, pair, times) of all links, each pair once a chunk, ascending."""
        wide = len(self.both.bytes_b)
        large = size_a * size_b > LARGE_GROUP
        g = np.flatnonzero(~large)
        many = size_a[g] * size_b[g]
        group = np.repeat(g, many)
        k = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
        i, j = np.divmod(k, size_b[group])
        pair = a[from_a[group] + i] * wide + b[from_b[group] + j]
        of, times = chunk[group], np.ones(len(pair), np.int64)
        for g in np.flatnonzero(large).tolist():
            ids_a, n_a = np.unique(a[from_a[g] : from_a[g] + size_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[from_b[g] : from_b[g] + size_b[g]], return_counts=True)
            pair = np.concatenate([pair, (ids_a[:, None] * wide + ids_b).ravel()])
            times = np.concatenate([times, np.outer(n_a, n_b).ravel()])
            of = np.concatenate([of, np.full(len(ids_a) * len(ids_b), chunk[g])])
        return summed(of, pair, times)

    def encode(self, texts: pa.ChunkedArray) -> dict:
        """For each text: n_a, n_b, n_groups, n_links, the hash of its groups, and its pairs and how often it has each, as
        arrays (pairs, times) with `upto`, where each text's end."""
        parts = [t.encode() if t else b"" for t in texts.to_pylist()]
        rows = [k for k, t in enumerate(parts) if t]
        data = np.frombuffer(b"".join(chain.from_iterable(zip(repeat(b" "), (parts[k] for k in rows), strict=False))), np.uint8)
        lengths = np.fromiter((len(parts[k]) + 1 for k in rows), np.int64, len(rows))
        del parts
        starts = np.cumsum(lengths) - lengths
        begins = chunk_starts(data, starts, self.both.cuts_hold)
        offsets = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.bytes > REMEMBERED_BYTES:
            self.start()
        known = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            new = [distinct[k] for k in fresh.tolist()]
            self.learn(new)
            known[fresh] = np.fromiter(map(self.numbers.__getitem__, new), np.int64, len(new))
        code = known[coded.indices.to_numpy(zero_copy_only=False)]
        first = np.append(np.searchsorted(begins, starts), len(begins))
        of = np.repeat(np.arange(len(rows)), np.diff(first))
        right = np.bincount(of, ~self.valid.room[code], minlength=len(rows)) == 0
        whole = np.sort(of[right[of]] << 32 | code[right[of]])
        at = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
        whole, times = whole[at], np.diff(at, append=len(whole))
        doc, held = whole >> 32, whole & 0xFFFFFFFF
        sizes = self.starts.room[held + 1] - self.starts.room[held]
        where = np.repeat(self.starts.room[held] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        doc, pair, times = summed(np.repeat(doc, sizes), self.pairs.room[where], self.times.room[where] * np.repeat(times, sizes))
        n = len(texts)
        out = {"upto": np.zeros(n, np.int64), "pairs": pair.astype(self.both.pair), "times": times, "groups_sha256": [""] * n}
        there = np.array(rows, np.int64)[right] if rows else np.zeros(0, np.int64)
        for name, kept in zip(("n_a", "n_b", "n_groups", "n_links"), self.counts, strict=True):
            out[name] = np.zeros(n, np.int64)
            out[name][there] = np.bincount(of, kept.room[code], minlength=len(rows)).astype(np.int64)[right]
        out["upto"][rows] = np.bincount(doc, minlength=len(rows))[: len(rows)]
        out["upto"] = np.cumsum(out["upto"])
        codes = code.tolist()
        for k in np.flatnonzero(right).tolist():
            text = "".join(map(self.groups.__getitem__, codes[first[k] : first[k + 1]]))
            out["groups_sha256"][rows[k]] = hashlib.sha256(text[:-1].encode()).hexdigest()
        return out


def summed(of: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, pair) ascending, each once, with the sum of its times."""
    order = np.lexsort((pair, of))
    of, pair, times = of[order], pair[order], times[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return of[at], pair[at], np.add.reduceat(times, at) if len(at) else times


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Each row of docs (doc_id, text) with its counts, the hash of its groups, its distinct pairs of linked ids (`pairs`) and
    how many links each has (`times`), in buckets of rows that were worked on together."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for table in steps(batches, limit=STEP_BYTES):
            found = tool.encode(table["text"])
            held += pc.sum(pc.binary_length(table["text"])).as_py() or 0
            n = table.num_rows
            cut = np.concatenate([[0], found["upto"]]).tolist()
            pairs, times = ([x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for x in (found["pairs"], found["times"].astype(np.uint32)))
            columns = [pa.array([bucket] * n), table["doc_id"].combine_chunks(), *(pa.array(found[c]) for c in COUNTS), pa.array(found["groups_sha256"]), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])
            if held >= BUCKET_BYTES:
                bucket, held = bucket + 1, 0

    schema = f"bucket long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def unpacked(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and the row of each."""
    parts = column.to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize
    return np.frombuffer(b"".join(parts), kind), np.repeat(np.arange(len(parts)), sizes)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """For each row of docs (doc_id, text): n_a, n_b tokens, n_groups, n_links, n_best (links whose pair of ids is linked in
    as many documents as any pair of its A id), count_sum (over the links, in how many documents their pair is linked), and
    groups_sha256. Null and empty texts, and those that the tokens don't give back byte for byte, have no tokens: zeros and
    ''. Repeated rows count as documents each; other columns are not read; an empty table gives none."""
    both = Tokenizers(byte_path, piece_path)
    kind, wide = both.pair, len(both.bytes_b)
    found = written(aligned(docs, byte_path, piece_path), "aligned")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches, "pairs", limit=16 << 20):
            pairs, row = unpacked(table["pairs"], kind)
            bucket = table["bucket"].to_numpy()[row]
            bucket, pair, n = summed(bucket, pairs.astype(np.int64), np.ones(len(row), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(pair), pa.array(n)], names=["bucket", "pair", "n"])

    asks = written(found.select("bucket", "pairs").mapInArrow(asked, "bucket long, pair long, n long"), "pairs-of-buckets")
    counts = written(asks.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a_id = F.expr(f"pair div {wide}L")
    best = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    judged = counts.withColumn("a_id", a_id).join(F.broadcast(best), "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asks.select("bucket", "pair").join(judged, "pair").select("bucket", "pair", "count", "best")

    def counted(rows: pa.Table, known: pa.Table) -> pa.Table:
        pair = known["pair"].to_numpy()
        order = np.argsort(pair)
        pair, count, is_best = pair[order], known["count"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order]
        pairs, row = unpacked(rows["pairs"], kind)
        times = unpacked(rows["times"], np.dtype(np.uint32))[0].astype(np.int64)
        at = np.searchsorted(pair, pairs.astype(np.int64))
        sums = [exact_sums(row, times * x, rows.num_rows) for x in ((is_best[at], count[at]) if len(at) else (times, times))]
        return rows.drop_columns(["bucket", "pairs", "times"]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return found.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(counted, schema)


def exact_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edge = np.searchsorted(row, np.arange(n + 1))
    return sums[edge[1:]] - sums[edge[:-1]]
