"""Whole-batch word handling on Arrow string buffers.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Those bytes never occur inside a
multi-byte UTF-8 character, so words can be cut on bytes and hashed without decoding. Everything
works on the concatenated bytes of a slice of documents; slices are bounded in bytes, so memory
does not depend on the batch, only on the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240817)
BYTE_VALUES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
WORD_BASE = [int(x) | 1 for x in _rng.integers(2**60, 2**63, size=2)]
GRAM_BASE = [int(x) | 1 for x in _rng.integers(2**60, 2**63, size=2)]
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer document stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class Words:
    """Words of a slice: byte ranges, and ``first[d]:first[d + 1]`` as the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        n = len(data)
        start, end = inside.copy(), inside.copy()
        if n:
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            start[cut] = inside[cut]
            end[cut - 1] = inside[cut - 1]
        self.inside = inside
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; ``which`` picks one of two independent functions."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        values = BYTE_VALUES[which][LOWER] if lower else BYTE_VALUES[which]
        lengths = self.end - self.start
        at = np.cumsum(lengths) - lengths
        power = powers(WORD_BASE[which], int(lengths.max()))
        inside = self.data[self.inside]
        place = np.arange(len(inside), dtype=np.int64) - np.repeat(at, lengths)
        total = np.add.reduceat(values[inside] * power[place], at)
        return mix(total + lengths.astype(np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive values, by doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = GRAM_BASE[which]
    out, width = None, 0
    part, span = hashes, 1
    size = len(hashes) - n + 1
    left = n
    while left:
        if left & 1:
            piece = part[width : width + size]
            out = piece.copy() if out is None else out * np.uint64(pow(base, span, 1 << 64)) + piece
            width += span
        left >>= 1
        if left:
            part = part[:-span] * np.uint64(pow(base, span, 1 << 64)) + part[span:]
            span *= 2
    return mix(out)


def sliding(values: np.ndarray, width: int, reduce=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    size, span, part = len(values) - width + 1, 1, values
    while span * 2 <= width:
        part = reduce(part[:-span], part[span:])
        span *= 2
    return reduce(part[:size], part[width - span : width - span + size])


def starts_inside(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that stay inside one document."""
    total = int(first[-1]) if len(first) else 0
    if total < n:
        return np.zeros(0, np.int64)
    fits = np.zeros(total + 1, dtype=np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - n + 1, first[:-1])
    np.add.at(fits, lo, 1)
    np.add.at(fits, hi, -1)
    return np.flatnonzero(np.cumsum(fits[:total]) > 0)


def ragged(values: np.ndarray, row_of: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """List column from values that are already ordered by row."""
    offsets = np.searchsorted(row_of, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
