"""Language identification by rank-order profiles (operator 4).

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words padded with a blank). A
document gets the language whose profile has the least out-of-place distance from the document's own list: the sum,
over the document's n-grams, of how far apart the two ranks are, an n-gram missing from the profile counting as the
profile's length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import beside, steps, unused

PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
#: Training rows of one language, about: beyond it rows are taken by a hash of all their columns.
MAX_ROWS_PER_LANGUAGE = 8_000
MAX_LANGUAGES = 5_000
UNDETERMINED = "und"
#: Training scores from which a language's limit is its own; with fewer it isn't above that of all languages together.
OWN_LIMIT_ROWS = 100
LOW_QUANTILE = 0.01
#: How far below the low quantile a limit is, as a share of that quantile's distance from the median.
REACH = 1.25
BLANK = 32
#: Code points of a text that are counted at once, about.
PART_POINTS = 1 << 16


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text's n-grams, ascending, and their counts; none if the text has no letter.

    A long text is counted in parts from blank to blank. No n-gram has a blank within, so none is lost or counted twice.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letters()[points], points, np.uint32(BLANK))
    points = np.concatenate([[np.uint32(BLANK)], points, [np.uint32(BLANK)]])
    points = points[np.concatenate([[True], (points[1:] != BLANK) | (points[:-1] != BLANK)])]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(points) <= PART_POINTS:
        return counted(points)
    blanks, cuts = np.flatnonzero(points == BLANK), [0]
    while cuts[-1] < len(points) - 1:
        cuts.append(int(blanks[min(np.searchsorted(blanks, cuts[-1] + PART_POINTS), len(blanks) - 1)]))
    found = [counted(points[x : y + 1]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of code points that begin and end with a blank and have no two blanks together."""
    points = points.astype(np.int64)
    pairs = points[:-1] << 21 | points[1:]
    triples = (pairs[:-1] << 21 | points[2:])[points[1:-1] != BLANK]
    codes = np.sort(np.concatenate([points[points != BLANK], pairs, triples]))
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profiles: a row for each n-gram, a column for each language."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def judge(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        top = codes[np.argsort(-counts, kind="stable")[:DOCUMENT_SIZE]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], PROFILE_SIZE)
        there = ranks < PROFILE_SIZE
        apart = np.where(there, np.abs(ranks - np.arange(len(top))[:, None]), PROFILE_SIZE)
        away = apart.sum(axis=0) / (PROFILE_SIZE * len(top))
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best])


def sampled(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """The rows of docs (text, lang, ...) that are learned from, where `train` holds.

    Rows with a null lang or a null text teach nothing, repeated rows count each. Of a language with more than
    MAX_ROWS_PER_LANGUAGE rows, that many (about) are taken by a hash of all columns, so that a text that is there under
    many ids isn't taken or left as a whole; rarer languages are taken whole.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(train) if train is not None else rows
    counts = dict(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return rows.filter(F.lit(False))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, MAX_ROWS_PER_LANGUAGE / n))))
    return rows.filter(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))


def learn(docs: DataFrame, train: Column | None = None) -> Profiles:
    """Profiles of the languages in `lang` from the rows that sampled() takes of docs.

    Ties of frequency go by n-gram code, so reruns agree. An empty table gives no profile, and every text is then
    undetermined.
    """
    return profiles_of(sampled(docs, train))


def profiles_of(rows: DataFrame) -> Profiles:
    """Profiles from all of rows (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches):
            by: dict[str, list] = {}
            for text, lang in zip(table["text"].to_pylist(), table["lang"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], names=["lang", "code", "n"])

    summed = rows.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = summed.withColumn("place", place).filter(F.col("place") <= PROFILE_SIZE)
    found = top.select("lang", "code", "place").collect()  # PROFILE_SIZE rows a language
    if not found:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    languages = sorted({r.lang for r in found})
    codes = np.array(sorted({r.code for r in found}), np.int64)
    ranks = np.full((len(codes), len(languages)), PROFILE_SIZE, np.int64)
    for lang, of in itertools.groupby(sorted(found), key=lambda r: r.lang):
        of = list(of)
        ranks[np.searchsorted(codes, [r.code for r in of]), languages.index(lang)] = [r.place - 1 for r in of]
    return Profiles(languages, codes, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score (0 to 1: how near the text is to that profile), from `text` alone.

    A null text and a text without a letter are `und` with score 0. Very long texts are taken whole, and repeated rows
    are judged alike. Other columns stay, whatever their names; older ones of these two names are replaced. Equal
    distances go to the language that sorts first. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE_SIZE codes a language

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score"])

    kept = beside(docs.columns, "lang_pred", "score")
    keep, found = [F.col(f"`{c}`") for c in kept], unused(kept, "judged")
    return docs.select(*keep, judged("text").alias(found)).select(*keep, f"{found}.lang_pred", f"{found}.score")


def nearness_limits(judged: DataFrame, least: float) -> tuple[dict[str, float], float]:
    """For each language the score below which a text isn't in it, and the limit of all others, from training rows, or a
    sample of them, (lang, lang_pred, score) that got their own language.

    A limit is REACH times as far below the scores' low quantile as that is below their median, but `least` at least.
    Copies have one score and count once. Where even all languages together have fewer than OWN_LIMIT_ROWS scores, all
    limits are `least`.
    """
    own = judged.filter(F.col("lang_pred") == F.col("lang")).select("lang_pred", "score").distinct()
    at = F.percentile(F.round("score", 3), F.array(F.lit(LOW_QUANTILE), F.lit(0.5)))  # a thousand values at most
    found = {r.lang_pred: r for r in own.rollup("lang_pred").agg(at.alias("at"), F.count("*").alias("n")).collect()}
    every = found.pop(None, None)
    if every is None or every.n < OWN_LIMIT_ROWS:
        return {}, least
    limit = lambda r: max(least, r.at[0] - REACH * (r.at[1] - r.at[0]))
    return {k: limit(r) if r.n >= OWN_LIMIT_ROWS else min(limit(r), limit(every)) for k, r in found.items()}, limit(every)
