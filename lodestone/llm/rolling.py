"""Hashes of words and of runs of words, for whole batches at once with numpy.

A hash is a polynomial modulo 2**64 over values from a fixed table, so that differences of one running sum give the hash
of any run; a last mixing step spreads its bits. Equal runs have equal hashes in every process.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


@cache
def _table(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, 256, _U), int(rng.integers(0, 1 << 61)) * 8 + 5


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """The words of a column of texts: hashes in one row, and where each text's words begin."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, seed: int = 1) -> None:
        parts = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        space = np.concatenate([[True], _SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        values, base = _table(seed)
        inverse = pow(base, -1, 1 << 64)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(values[data] * _powers(base, len(data)), out=sums[1:])
        self.hashes = mixed((sums[self.end] - sums[self.begin]) * _powers(inverse, len(data) + 1)[self.begin])
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.data = data
        self.starts = np.append(np.searchsorted(self.begin, starts), len(self.begin)).astype(np.int64)

    def runs(self, length: int, seed: int = 2) -> np.ndarray:
        """The hash of the run of `length` words from each word on; those that don't fit in their text have no meaning."""
        _, base = _table(seed)
        n = len(self.hashes)
        sums = np.zeros(n + length, _U)
        np.cumsum(self.hashes * _powers(base, n), out=sums[1 : n + 1])
        sums[n + 1 :] = sums[n]
        return mixed((sums[length : n + length] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the number of its text, and its place there."""
        counts = np.diff(self.starts)
        of = np.repeat(np.arange(len(counts)), counts)
        return of, np.arange(len(self.hashes)) - self.starts[of]
