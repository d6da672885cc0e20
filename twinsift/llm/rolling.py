"""Vectorised hashing of words and characters, shared by the text operators.

Everything works on whole Arrow batches in numpy; no Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier has an inverse modulo 2**64, so prefix sums give the hash of any slice.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that one numpy pass works on: bounds a worker's memory, whatever the batch.
SLAB = 1_000_000

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 4096), base, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(grown)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Slices:
    """Hashes of arbitrary slices of one sequence of numbers, from its prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n + 1)[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end))

    def grams(self, q: int) -> np.ndarray:
        """The hash of every run of ``q`` values, by its start."""
        n = len(self.sums) - 1
        if n < q:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[q:] - self.sums[:-q]) * self.inverse[: n - q + 1])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, distinct within it, and the text's index: sorted by index, hash.

    Words are the maximal runs of ASCII letters, digits and underscore after lower-casing.
    """
    raw = np.frombuffer(" ".join(t.lower() for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    lengths = np.array([len(t.lower().encode("utf-8", "surrogatepass")) if not t.isascii() else len(t) for t in texts], np.int64)
    part = np.zeros(len(raw) + 2, np.int8)
    word = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw == 95)
    part[1 : len(raw) + 1] = word
    edge = np.diff(part)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    own = Slices(raw).hash(start, end)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text_of = np.searchsorted(begins, start, side="right") - 1
    n = len(start) - k + 1
    whole = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            whole = mixed(whole * np.uint64(BASE) + own[i : i + n])
    inside = text_of[:n] == text_of[k - 1 : k - 1 + n]
    at, whole = text_of[:n][inside], whole[inside]
    order = np.lexsort((whole, at))
    at, whole = at[order], whole[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    return at[fresh], whole[fresh]


def slabs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts in pieces of about SLAB characters: the first row, and the texts (null as empty)."""
    texts = batch.column(column)
    first, size, piece = 0, 0, []
    for i in range(len(texts)):
        value = texts[i].as_py() or ""
        piece.append(value)
        size += len(value)
        if size >= SLAB:
            yield first, piece
            first, size, piece = i + 1, 0, []
    if piece:
        yield first, piece


def window_least(values: np.ndarray, w: int) -> np.ndarray:
    """For every ``w`` consecutive values the position of their leftmost minimum. Values are below 2**32.

    A value and its position share one 64-bit number, so the minimum of a window names its place; running minima over
    blocks of ``w``, forwards and backwards, give every window's minimum in a fixed number of passes.
    """
    n = len(values)
    if n < w or w < 1:
        return np.empty(0, np.int64)
    placed = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    placed[:n] = (values.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    blocks = placed.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some ``w`` consecutive values, ascending. Values are below 2**32."""
    least = window_least(values, w)
    return least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
