"""Words of Arrow string columns as 64-bit hashes, vectorised over the bytes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _STEP)


_BYTE = constants(256, 1)
_BASE = constants(1, 2)[0] | np.uint64(1)
_LENGTH = constants(1, 3)[0] | np.uint64(1)


class _Powers:
    table = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            full = np.full(max(n, 2 * len(cls.table)), _BASE, np.uint64)
            full[0] = 1
            cls.table = np.multiply.accumulate(full)
        return cls.table


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; nulls are empty. A row over the limit is a chunk of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the number of words)."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    where = np.flatnonzero(start)
    begins = np.searchsorted(where, offsets)
    chars = data[inside]
    if not len(where):
        return np.empty(0, np.uint64), begins
    at = np.cumsum(inside)[where] - 1
    lengths = np.diff(np.append(at, len(chars)))
    place = np.arange(len(chars)) - np.repeat(at, lengths)
    powers = _Powers.upto(int(lengths.max()))
    value = _BYTE[_LOWER[chars] if lower else chars] * powers[place]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64) * _LENGTH), begins


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes, in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out * _BASE + p
    return mix(out + np.uint64(len(parts)) * _LENGTH)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document, the sorted distinct hashes of its size-word shingles; with fewer words, of all its words."""
    h, at = word_hashes(data, offsets)
    n = len(h) - size + 1
    rolled = fold([h[k : k + n] for k in range(size)]) if n > 0 else h[:0]
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        else:
            out.append(fold([h[k : k + 1] for k in range(a, b)]) if b > a else h[:0])
    return out
