"""SentencePiece encoding by sampling, and decoding (operator 3).

All ways to cut a text into pieces of the vocabulary form a lattice. A forward pass sums, at each place, the weights of
all ways to get there; a backward pass then draws the last piece in proportion to the ways through it, the one before,
and so on (forward filtering, backward sampling). The draws come from a hash of the row's key, the place and the step,
so a row is always cut in the same way, wherever it is processed.

Blanks become the mark U+2581, with one more before the text, and no piece crosses a mark, so the lattice of a text is
that of its chunks, each built once for all its occurrences. A chunk has one lattice, however long it is: sums are
rescaled as they go along, and those of a very long chunk are kept at the edges of blocks only, whose lattices are built
again on the way back. A character without a piece becomes its UTF-8 bytes, and so
does the mark itself where a text has it, which keeps decoding lossless. The model's scores are places in its list of
merges; a piece at place r has weight 1 / (r + OFFSET).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rolling import mixed
from lodestone.llm.shared import beside, steps, unused

MARK = 0x2581
#: Stands for the mark where a text has it.
OWN_MARK = 0x20000000
OFFSET = 10.0
#: Weights grow by this factor for each code point, the same for all ways to a place, and after so many code points the
#: sums are brought back to 1, both against underflow.
LIFT = 100.0
RESCALED = 32
#: Code points of a block, and of the longest chunk that isn't worked on in blocks.
BLOCK = 8192
#: Bytes of text whose lattices are in memory at once; a longer text is cut at blanks.
STEP_BYTES = 1 << 18
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, U)
    found[:1] = 1
    return np.multiply.accumulate(found)


class Pieces:
    """The vocabulary: a hash table of all beginnings of pieces, and the bytes of each id."""

    SLOTS = 1 << 21
    PROBES = 8

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.weights = np.full(self.size + 1, 1e-6 * LIFT)  # with what it grows by; the last is that of other code points
        texts, plain = [], {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace("▁", " ").encode())
                if "▁" not in piece[1:]:
                    plain[piece] = i
                    self.weights[i] = LIFT ** len(piece) / (min(-model.get_score(i), self.size) + OFFSET)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.longest = max(map(len, plain))
        begun = {p[:k]: -1 for p in plain for k in range(1, len(p))} | plain
        self.keys = np.zeros(self.SLOTS + self.PROBES, U)
        self.values = np.full(self.SLOTS + self.PROBES, -1, np.int32)
        powers_ = powers(BASE, self.longest)
        for length in range(1, self.longest + 1):
            some = [(t, i) for t, i in begun.items() if len(t) == length]
            points = np.frombuffer("".join(t for t, _ in some).encode("utf-32-le"), np.uint32).reshape(-1, length)
            hashes = mixed((mixed(points.astype(U) + U(1)) * powers_[:length]).sum(axis=1, dtype=U))
            for h, (_, i) in zip(hashes.tolist(), some, strict=True):
                slot = h >> 43
                while self.keys[slot]:
                    slot += 1
                    assert slot - (h >> 43) < self.PROBES
                self.keys[slot], self.values[slot] = h, i

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether something begins so, and the id of the piece (-1: none)."""
        slots = (hashes >> U(43)).astype(np.int64)
        found, ids = np.zeros(len(hashes), bool), np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        for k in range(self.PROBES):
            keys = self.keys[slots[open_] + k]
            hit = keys == hashes[open_]
            found[open_[hit]], ids[open_[hit]] = True, self.values[slots[open_[hit]] + k]
            open_ = open_[~hit & (keys != 0)]
            if not len(open_):
                break
        return found, ids


class Lattice:
    """The filtered lattice of many chunks. Node s + c + k stands after k code points of chunk c, which begins at s.

    known: sums of the first nodes of a single chunk, which continues another; nothing is drawn from those nodes on.
    """

    def __init__(self, pieces: Pieces, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: np.ndarray | None = None) -> None:
        n, chunks = len(points), len(starts)
        chunk = np.repeat(np.arange(chunks, dtype=np.int32), lengths)
        place = np.arange(n, dtype=np.int32)
        left = (starts + lengths).astype(np.int32)[chunk] - place
        before = place - starts.astype(np.int32)[chunk]
        sums = np.concatenate([[U(0)], np.cumsum(mixed(points.astype(U) + U(1)) * powers(BASE, n))])
        back = powers(INVERSE, n)
        at, made = place, []
        for length in range(1, pieces.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            found, ids = pieces.find(mixed((sums[at + length] - sums[at]) * back[at]))
            here = ids >= 0
            if length == 1:  # code points without a piece: ids beyond the vocabulary
                ids, begin = np.where(here, ids, pieces.size + points[at]).astype(np.int32), at
            else:
                ids, begin = ids[here], at[here]
            made.append((begin + chunk[begin], before[begin] + np.int32(length), ids, np.full(len(begin), length, np.int32)))
            at = at[found]
        source, depth, ids, length = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int32),) * 4
        self.first = starts + np.arange(chunks)
        self.last = self.first + lengths
        ways = np.zeros(n + chunks)
        if known is None:
            ways[self.first] = 1
        else:
            ways[: len(known)] = known
            new = depth >= len(known)
            source, depth, ids, length = source[new], depth[new], ids[new], length[new]
        depth = depth.astype(np.uint16)  # at most BLOCK and an overlap
        order = np.argsort(depth, kind="stable")
        source, ids = source[order], ids[order]
        target = source + length[order]
        weight = pieces.weights[np.minimum(ids, pieces.size)]
        deepest = int(lengths.max(initial=0))
        cuts = np.searchsorted(depth[order], np.arange(1, deepest + 2))
        part = np.zeros(len(source))
        for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
            if a == b:
                continue
            through = ways[source[a:b]] * weight[a:b]
            np.add.at(ways, target[a:b], through)
            part[a:b] = through / ways[target[a:b]]
            if d % RESCALED == 0 and d < deepest:
                edge = self.first[lengths > d] + d
                scale = ways[edge]
                for k in range(min(pieces.longest, d + 1)):
                    ways[edge - k] /= scale
        self.ways = ways
        order = np.argsort(target, kind="stable")
        self.source, self.ids, target = source[order], ids[order], target[order]
        share = np.minimum(part[order] * 2.0**32, 2.0**32 - 1).astype(np.int64)
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        self.opens = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        upto = np.cumsum(share)
        upto -= (upto - share)[self.opens][node]
        self.closes = np.append(self.opens[1:], len(target)) - 1
        upto[self.closes] = 1 << 32
        self.cumulated = (node << 33) + upto
        self.node = np.zeros(n + chunks, np.int64)
        self.node[target] = node

    def walk(self, place: int, least: int, draws: np.ndarray) -> tuple[list[int], int]:
        """The ids of a way back from a node of a single chunk to the first that is at most `least`, last first, and
        that node."""
        out = []
        for u in draws.tolist():
            edge = int(np.searchsorted(self.cumulated, (int(self.node[place]) << 33) + u, side="right"))
            out.append(int(self.ids[edge]))
            place = int(self.source[edge])
            if place <= least:
                break
        return out, place

    def sample(self, chunks: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a way through each of the chunks: all ids one after the other, and how many each has."""
        where, active = self.last[chunks].copy(), np.arange(len(chunks))
        drawn, counts, step = [], np.zeros(len(chunks), np.int64), 0
        while len(active):
            node = self.node[where[active]]
            u = (mixed(seeds[active] + U(step * BASE % (1 << 64))) >> U(32)).astype(np.int64)  # as draws()
            edge = np.searchsorted(self.cumulated, (node << 33) + u, side="right")
            drawn.append((active, self.ids[edge]))
            where[active] = self.source[edge]
            step += 1
            done = where[active] == self.first[chunks[active]]
            counts[active[done]] = step
            active = active[~done]
        begins = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (who, ids) in enumerate(drawn):
            out[begins[who] + counts[who] - 1 - k] = ids
        return out, counts


def draws(seed: np.uint64, step: int, n: int) -> np.ndarray:
    """The numbers of 32 bits that a chunk's draws from a step on go by."""
    return (mixed(seed + np.arange(step, step + n, dtype=U) * U(BASE)) >> U(32)).astype(np.int64)


def blank_cuts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, each up to a blank, which is dropped."""
    at = 0
    while len(text) - at > size and (end := text.find(" ", at + size)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Sampler:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. keys: the texts' seeds."""
        longest = pc.max(pc.binary_length(texts)).as_py() or 0
        if longest <= STEP_BYTES:
            return self.encode_step(texts, keys)[:2]
        out, counts = [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts.to_pylist()):
            before = 0
            for part in blank_cuts(text, STEP_BYTES // 4):
                ids, count, places = self.encode_step(pa.array([part], pa.string()), keys[row : row + 1], before)
                out.append(ids)
                counts[row] += count[0]
                before += places
        return np.concatenate(out), counts

    def encode_step(self, texts: pa.Array, keys: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The same of texts whose lattices fit in memory, and the number of chunks. before: the chunks of the first
        text's beginning, which came before."""
        rows = len(texts)
        chunks = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary
        sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct.cast(pa.string())), "")
        points = np.frombuffer(joined[0].as_py().encode("utf-32-le"), np.int32)
        points = np.where(points == MARK, np.int32(OWN_MARK), points)
        points = np.insert(points, np.cumsum(sizes) - sizes, MARK)
        sizes = sizes + 1
        begins = np.cumsum(sizes) - sizes
        of = coded.indices.to_numpy(zero_copy_only=False)
        in_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(rows), in_text)
        place = np.arange(len(of)) - np.repeat(np.cumsum(in_text) - in_text, in_text)
        seeds = mixed(keys.view(U)[text] ^ mixed((place + before).astype(U) + U(1)))
        long = sizes > BLOCK
        if not long.any():
            ids, counts = Lattice(self.pieces, points, begins, sizes).sample(of, seeds)
        else:
            ids, counts = self.with_long(points, begins, sizes, of, seeds)
        owner = np.repeat(text, counts)
        odd = ids >= self.pieces.size
        if odd.any():
            ids, owner = self.with_bytes(ids, owner, odd)
        return ids.astype(np.int32), np.bincount(owner, minlength=rows), len(of)

    def with_long(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray, of: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws for all chunks `of`, of which some are long: all ids one after the other, and how many each has."""
        short = sizes <= BLOCK
        number = np.cumsum(short) - 1
        some = sizes[short]
        which = short[of]
        ids, counts = np.zeros(0, np.int64), np.zeros(len(of), np.int64)
        if len(some):
            lattice = Lattice(self.pieces, points[np.repeat(short, sizes)], np.cumsum(some) - some, some)
            ids, counts[which] = lattice.sample(number[of[which]], seeds[which])
        drawn = {k: self.sample_long(points[begins[of[k]] : begins[of[k]] + sizes[of[k]]], seeds[k]) for k in np.flatnonzero(~which).tolist()}
        for k, found in drawn.items():
            counts[k] = len(found)
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int64)
        out[np.repeat(which, counts)] = ids
        for k, found in drawn.items():
            out[ends[k] - len(found) : ends[k]] = found
        return out, counts

    def sample_long(self, points: np.ndarray, seed: np.uint64) -> np.ndarray:
        """A way through one chunk in blocks: forward keeping the sums at their edges, then back."""
        n, known, begin, edges = len(points), np.ones(1), 0, []
        while True:
            end = min(begin + len(known) - 1 + BLOCK, n)
            edges.append((begin, end, known))
            if end == n:
                break
            ways = self.block(points, *edges[-1]).ways
            known = ways[max(0, end + 1 - self.pieces.longest - begin) : end - begin + 1]
            known, begin = known / known[-1], end + 1 - len(known)
        out, place = [], n
        for begin, end, known in reversed(edges):
            lattice = self.block(points, begin, end, known)
            ids, local = lattice.walk(place - begin, len(known) - 1, draws(seed, len(out), place - begin))
            out += ids
            place = begin + local
        return np.array(out[::-1], np.int64)

    def block(self, points: np.ndarray, begin: int, end: int, known: np.ndarray) -> Lattice:
        return Lattice(self.pieces, points[begin:end], np.zeros(1, np.int64), np.array([end - begin]), known)

    def with_bytes(self, ids: np.ndarray, owner: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece replaced by their bytes."""
        values, at = np.unique(ids[odd] - self.pieces.size, return_inverse=True)
        coded = [chr(MARK if v == OWN_MARK else v).encode() for v in values.tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = np.array([len(c) for c in coded])[at]
        wide = np.repeat(ids, size)
        wide[np.repeat(odd, size)] = self.pieces.byte_ids[np.frombuffer(b"".join(coded[k] for k in at.tolist()), np.uint8)]
        return wide, np.repeat(owner, size)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes, without the blank that was put before each."""
        sizes = self.pieces.lengths[ids]
        ends = np.cumsum(sizes)
        data = self.pieces.bytes[np.repeat(self.pieces.starts[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def sampler(path: str) -> Sampler:
    return Sampler(path)


def encode(docs: DataFrame, model: str, key: Column | None = None) -> DataFrame:
    """docs with ids (array of int) and n_pieces of `text`. key: what seeds a row's draws, doc_id unless given.

    A null text has null ids and no pieces; an empty one has the piece of the blank put before it. Rows with equal keys
    and texts, so repeated rows too, are cut alike, and a null key is a key. Shares of a draw are held in 32 bits, so two
    ways of equal weight may differ by 2**-32. Very long texts are cut at blanks, and chunks without a blank worked on in
    blocks, which changes no draw. An empty table gives an empty one. Other columns stay, whatever their names; older
    ones of these two are replaced.
    """
    keep = beside(docs.columns, "ids", "n_pieces")
    seed = unused(keep, "seed")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.xxhash64(F.col("doc_id") if key is None else key).alias(seed))
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, n_pieces long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = sampler(model)
        for table in steps(batches, limit=STEP_BYTES):
            texts = table["text"].combine_chunks()
            missing = pc.is_null(texts).to_numpy(zero_copy_only=False)
            ids, counts = cut.encode(pc.fill_null(texts, ""), table[seed].to_numpy().astype(np.int64))
            ids, counts = ids[np.repeat(~missing, counts)], np.where(missing, 0, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids), mask=pa.array(missing))
            out = table.drop_columns([seed]).append_column("ids", lists).append_column("n_pieces", pa.array(counts.astype(np.int64)))
            yield from out.to_batches()

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with decoded, the text of ids; null for null ids. Other columns stay; an older one of this name is replaced."""
    keep = beside(rows.columns, "decoded")
    schema = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = sampler(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = cut.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
                missing = pc.is_null(lists).to_pylist()
                decoded = pa.array([None if m else t.decode() for t, m in zip(texts, missing, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return rows.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
