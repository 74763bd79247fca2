"""Whole Arrow text columns as NumPy arrays: words, hashes of spans, hashes of sliding windows, winnowing.

A column's bytes are one buffer with the start of every text. Prefix sums of (value of byte) * base^position, modulo 2^64,
give the hash of any span by one subtraction and one multiplication, so no loop runs over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; one longer text is handled alone.
SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n at least."""
    return _powers(max(19, int(n).bit_length()))


class Prefix:
    """Prefix sums over values: the hash of any span of them."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(BASE))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every run of ``size`` values, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, start of each value and the end); missing values are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


class Words:
    """Words of all texts of a buffer: byte range of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        inside = ~IS_SPACE[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = starts[(starts > 0) & (starts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, starts)

    def values(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each word."""
        return Prefix(BYTE_VALUE[data]).spans(self.start, self.end)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` neighbours, by the first of them."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[size - 1 : size - 1 + n])


class Winnowed:
    """Windows of ``length`` tokens, each represented by the smallest hash among its grams of ``gram`` tokens (leftmost of ties).

    Equal windows have the same representative at the same place. Neighbouring windows of a text with the same representative
    form a run: ``lo`` its first window, ``n`` their number, ``at`` the representative's token, ``hash`` its gram's hash.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray, length: int, gram: int):
        self.prefix = Prefix(values)
        grams = self.prefix.windows(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        best = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
        best &= np.uint64(0xFFFFFFFF)
        ok = np.zeros(len(best) + 1, np.int8)
        has = np.diff(first) >= length
        np.add.at(ok, first[:-1][has], 1)
        np.add.at(ok, first[1:][has] - length + 1, -1)
        ok = np.cumsum(ok)[:-1].astype(bool)
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (best[1:] != best[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (best[1:] != best[:-1])
        self.lo = np.flatnonzero(new)
        self.n = np.flatnonzero(last) - self.lo + 1
        self.at = best[self.lo].astype(np.int64)
        self.hash = grams[self.at]
        self.text = np.searchsorted(first, self.lo, side="right") - 1
        self.length = length

    def run_hash(self) -> np.ndarray:
        """Hash of all tokens of each run's windows, and of the representative's place in them."""
        return mix(self.prefix.spans(self.lo, self.lo + self.n + self.length - 1) ^ ((self.at - self.lo).astype(np.uint64) * np.uint64(BASE)))
