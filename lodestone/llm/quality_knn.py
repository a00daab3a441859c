"""Quality classifier (operator 5): nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, hashed; runs of three character classes (letters by case, digits, blanks, line breaks, each
sign by itself), hashed; and levels of how much its words, word pairs and lines repeat. A truncated singular value decomposition of a
bounded sample of labelled texts gives the latent space. The sample's vectors and labels are broadcast; every document's
cosine with each of them is computed, in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rolling import Words, mixed
from lodestone.llm.shared import beside, steps

#: Labelled rows that the space is fitted on and that vote, at most; a hash of the id chooses among more.
MAX_VOTERS = 4_000
NEIGHBOURS = 15
#: Similarities are raised to this power, so that the nearest of the neighbours count most.
SHARPNESS = 16
DIMENSIONS = 48
TERMS = 512
LEVELS = 8
REPETITIONS = 4
WORD_TERMS = 512
WORDS_FROM = TERMS + LEVELS * REPETITIONS
WIDTH = WORDS_FROM + WORD_TERMS
THRESHOLD = 0.3
#: Weights of a repetition level, and of all words, against all of a text's character runs, whose vector has length 1.
LEVEL_WEIGHT = 0.5
WORD_WEIGHT = 0.5


def _classes() -> np.ndarray:
    table = np.arange(256)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[0xC0:] = ord("a")  # first bytes of letters with accents and of other scripts
    table[0x80:0xC0] = 1
    return table.astype(np.int64)


CLASSES = _classes()
_HASH = (mixed(np.arange(1 << 21, dtype=np.uint64) + np.uint64(5)) % np.uint64(TERMS)).astype(np.int32)


def repeated_share(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """For each text, the share of its values that it has had before."""
    order = np.lexsort((values, of))
    again = (values[order][1:] == values[order][:-1]) & (of[order][1:] == of[order][:-1])
    return np.bincount(of[order][1:][again], minlength=rows) / np.maximum(np.bincount(of, minlength=rows), 1)


def features(texts: pa.ChunkedArray) -> np.ndarray:
    """A row of WIDTH weights for each text; zeros for null and empty ones."""
    rows = len(texts)
    out = np.zeros((rows, WIDTH), np.float32)
    words = Words(texts)
    data = CLASSES[words.data]
    lengths = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    if len(data) > 2:
        runs = _HASH[data[:-2] << 14 | data[1:-1] << 7 | data[2:]]
        of = np.repeat(np.arange(rows), lengths + 1)[: len(runs)]
        inside = np.arange(len(runs)) + 2 < (starts + lengths)[of]
        counts = np.bincount(of[inside] * TERMS + runs[inside], minlength=rows * TERMS).reshape(rows, TERMS)
        out[:, :TERMS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    of, place = words.places()
    counts = np.diff(words.starts)
    cell = of * WORD_TERMS + (words.hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    found = np.bincount(cell, minlength=rows * WORD_TERMS).reshape(rows, WORD_TERMS)
    out[:, WORDS_FROM:] = WORD_WEIGHT * np.sqrt(found / np.maximum(counts, 1)[:, None])
    shares = [repeated_share(words.hashes, of, rows)]
    for n in (2, 5):
        fits = place + n <= counts[of] if len(of) else np.zeros(0, bool)
        shares.append(repeated_share(words.runs(n)[fits], of[fits], rows))
    lines = [[x for x in (t.as_py() or "").split("\n") if x] for t in texts]
    shares.append(np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]))
    for k, share in enumerate(shares):
        level = np.minimum((share * LEVELS).astype(np.int64), LEVELS - 1)
        out[np.arange(rows), TERMS + k * LEVELS + level] = np.where(counts > 0, LEVEL_WEIGHT, 0)
    return out


@dataclass(frozen=True)
class Voters:
    """weights: of the terms; space: terms by dimensions; vectors and labels: of the voters; prior: the mean label."""

    weights: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.weights) @ self.space
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def score(self, texts: pa.ChunkedArray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        rows = features(texts)
        cosines = self.place(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** SHARPNESS
        total = weights.sum(1)
        voted = (weights * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where((total > 0) & rows.any(1), voted, self.prior), 0, 1)


def fit(rows: np.ndarray, labels: np.ndarray) -> Voters:
    if not len(labels):
        return Voters(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1.0
    weighted = (rows * weights).astype(np.float64)
    values, vectors = np.linalg.eigh(weighted.T @ weighted)
    space = vectors[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
    model = Voters(weights.astype(np.float32), space, np.zeros((0, 1), np.float32), labels.astype(float), float(labels.mean()))
    return Voters(model.weights, space, model.place(rows), model.labels, model.prior)


def learn(docs: DataFrame, labels: DataFrame) -> Voters:
    """Voters from labels (doc_id, label 0 or 1) and docs (doc_id, text); rows with a null id or label teach nothing.

    Of more than MAX_VOTERS labels, those with the least hashes of their ids are taken, and of more than so many texts that
    have these ids, those with the least hashes of their texts. Documents that have several labels vote with each,
    repeated rows once. Without labels every score is 0.5.
    """
    usable = labels.select("doc_id", "label").filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MAX_VOTERS)  # a bounded table
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    found = found.dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(MAX_VOTERS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches):
            rows = pa.array([x.tobytes() for x in features(table["text"])], pa.binary())
            yield from pa.table([table["doc_id"], table["label"].cast(pa.int32()), rows], names=["doc_id", "label", "row"]).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(found.mapInArrow(describe, f"doc_id {kind}, label int, row binary").collect())  # at most MAX_VOTERS
    rows = np.array([np.frombuffer(r.row, np.float32) for r in got]).reshape(-1, WIDTH)
    return fit(rows, np.array([r.label for r in got]))


def judge(docs: DataFrame, voters: Voters) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on), from `text` alone.

    Null and empty texts get the voters' mean label. Of voters that are as near as the last that counts, any may vote.
    Very long texts are taken whole, repeated rows get one score, and an empty table gives an empty one. Other columns
    stay, whatever their names; older ones of these two are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # MAX_VOTERS vectors

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = [shared.value.score(t["text"]) for t in steps(iter([pa.record_batch({"text": pa.array(texts, pa.string())})]))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    keep = [F.col(f"`{c}`") for c in beside(docs.columns, "score", "predicted")]
    out = docs.select(*keep, scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
