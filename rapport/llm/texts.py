"""Words and lines of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D; these are ASCII, so cutting bytes cuts code points exactly.
Nulls count as empty texts. Everything works on slices of bounded size; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers kept from call to call; longer words and lines have theirs computed anew.
_KEPT = 1 << 12


@dataclass
class Rows:
    """Texts ``first .. first + len(begin) - 1`` of a column: their bytes and where each begins and ends."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Rows]:
    """The column's texts in slices of about ``most`` bytes, at least one text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        high = min(high, n)
        yield Rows(low, data[at[low]:at[high]], at[low:high] - at[low], at[low + 1:high + 1] - at[low])
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def words(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row (within the slice) of every word."""
    space = _SPACE[rows.data]
    n = len(space)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[rows.begin] = True
    cut[n] = True
    start = ~space
    start[1:] &= space[:-1] | cut[1:n]
    stop = ~space & (np.append(space[1:], True) | cut[1:])
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(rows.begin, begin, "right") - 1


def lines(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every line; lines end at ``\\n`` and may be empty."""
    breaks = np.flatnonzero(rows.data == 0x0A)
    filled = rows.end > rows.begin
    begin = np.unique(np.concatenate([rows.begin[filled], breaks + 1]))
    begin = begin[begin < len(rows.data)]
    row = np.searchsorted(rows.begin, begin, "right") - 1
    end = rows.end[row]
    following = np.searchsorted(breaks, begin, "left")
    has = following < len(breaks)
    end[has] = np.minimum(end[has], breaks[following[has]])
    return begin, end, row


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _raised(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)


_FIRST = _raised(_KEPT)


def _powers(n: int) -> np.ndarray:
    return _FIRST if n <= _KEPT else _raised(n)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-overlapping, ordered, non-empty) byte range."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    length = end - begin
    powers = _powers(max(int(length.max()), _KEPT))
    total = int(length.sum())
    head = np.cumsum(length) - length
    offset = np.arange(total, dtype=np.int64) - np.repeat(head, length)
    value = (data[offset + np.repeat(begin, length)].astype(np.uint64) + np.uint64(1)) * powers[offset]
    return mixed(np.add.reduceat(value, head) + length.astype(np.uint64) * _BASE)


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of whole ``weights``, for each of ``n`` rows."""
    return np.bincount(row, weights, n).astype(np.int64)
