"""Words, hashes and windows of many texts at once, as numpy arrays.

A slice of texts is one byte array with row offsets, as Arrow holds it. All helpers are
vectorised over the bytes of a slice; NULL texts count as empty. Hashes are 64 bits wide
and the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
MULTIPLIER = 0x9E3779B97F4A7C55
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
SPACE_OR_PUNCTUATION = SPACE.copy()
SPACE_OR_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values: each input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: What each byte value adds to a hash.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


#: Powers so far; they grow with the largest slice seen.
_HELD: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2**64, up to n at least."""
    if not _HELD or len(_HELD[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        out = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
        _HELD[:] = out
    return _HELD[0], _HELD[1]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; the last offset is the length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, bytes, offsets.

    A text is never cut; one above the limit is a slice of its own.
    """
    data, off = as_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not gaps, and per row the
    index of its first word (one more entry than rows). Words do not cross rows."""
    inside = ~gaps[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which span_hash has any span's hash."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, for each pair."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def shingle_hash(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and per row the index of the first run.

    ``first``: per row the index of its first word, and the number of words at the end.
    """
    total = max(0, len(word) - n + 1)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h *= _U(MULTIPLIER)
        h += word[k : k + total]
    counts = np.diff(first)
    runs = np.maximum(counts - n + 1, 0)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    pick = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    return mix(h[pick] + _U(n)), at


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct_in_rows(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by both."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
