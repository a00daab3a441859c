"""Documents with every kind of trouble."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, n: int) -> str:
    random.seed(seed)
    return " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, short and very long texts, copies, near copies, passages that texts share, repeated rows, null
    keys, and white space of other scripts."""
    shared, near = passage(1, 60), passage(2, 120)
    texts = [
        None, "", "  \n\t ", "word", "one two", "one two", shared, f"{passage(3, 20)}\n{shared} {passage(4, 30)}", f"{shared}\t{shared}",
        near, near.replace(" ", "\n", 3), near.rsplit(" ", 2)[0], passage(5, 9000), "x" * 50_000, "é\u00a0ü \u2003ñ ▁ \U0001f600 <|endoftext|> <s>", "A.\nA.\nB\n\nA.",
        "\x00 nul", " ".join(["again"] * 200), passage(6, 36), passage(6, 35),
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, shared, None, None, 1), (None, None, None, None, None), (21, near, "en", "a", 5), (1 << 40, "last", "de", "b", 4)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def with_extras(frame, *names):
    """The frame with more columns, some of them named as an operator's own."""
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit(7) for n in names})
