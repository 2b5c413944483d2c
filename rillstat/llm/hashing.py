"""Vectorised hashes of words, shingles and character q-grams of Arrow string columns.

All functions work on the contiguous UTF-8 bytes of a batch, so a batch costs a
few numpy passes and no Python call per word. Hashes have 64 bits and depend on
the bytes alone, never on a process, so every executor gets the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd number, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15

#: Spans of up to this many characters are hashed together, in blocks that fit a core's cache.
_BLOCK = 1 << 16

#: Bytes that separate words: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < count``."""
    out = np.ones(count, dtype=np.uint64)
    filled = 1
    while filled < count:
        take = min(filled, count - filled)
        out[filled:filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
        filled += take
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(starts, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes outside ``space``) and the rows' ``n + 1`` offsets into them."""
    inside = ~space[data]
    edge = np.empty(len(data), dtype=bool)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    edge[:1] = inside[:1]
    edge[1:] = inside[1:] & ~inside[:-1]
    edge[edges] = inside[edges]
    starts = np.flatnonzero(edge)
    edge[-1:] = inside[-1:]
    edge[:-1] = inside[:-1] & ~inside[1:]
    edge[edges - 1] = inside[edges - 1]
    return starts, np.flatnonzero(edge) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, starts ascending; ``data`` holds bytes or code points.

    A polynomial hash from running sums: the sum up to the end less that up to
    the start, divided by the power at the start.
    """
    up, down = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)
    out = np.zeros(len(starts), dtype=np.uint64)
    half = _BLOCK // 2
    sums = np.zeros(_BLOCK + 1, dtype=np.uint64)
    bounds = np.searchsorted(starts, np.arange(0, len(data) + half, half))
    for k in range(len(bounds) - 1):
        low, high, begin = bounds[k], bounds[k + 1], k * half
        if low == high:
            continue
        while high > low and ends[high - 1] - begin > _BLOCK:
            high -= 1
            out[high] = _long_span(data[starts[high]:ends[high]], up)
        if low == high:
            continue
        reach = int(ends[high - 1]) - begin
        block = data[begin:begin + reach].astype(np.uint64)
        block += np.uint64(1)
        block *= up[:reach]
        np.cumsum(block, out=sums[1:reach + 1])
        s = starts[low:high] - begin
        out[low:high] = (sums[ends[low:high] - begin] - sums[s]) * down[s]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(out)


def _long_span(piece: np.ndarray, up: np.ndarray) -> np.uint64:
    value, shift, step = 0, 1, pow(_BASE, len(up), 1 << 64)
    for begin in range(0, len(piece), len(up)):
        part = piece[begin:begin + len(up)].astype(np.uint64) + np.uint64(1)
        value += int((part * up[:len(part)]).sum(dtype=np.uint64)) * shift
        shift = shift * step % (1 << 64)
    return np.uint64(value % (1 << 64))


def word_hashes(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of a string column and the rows' ``n + 1`` offsets into them."""
    data, offsets = utf8(column)
    starts, ends, bounds = words(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), bounds


def distinct_by_row(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``values[start:end]`` of each row, ascending, and their ``n + 1`` offsets."""
    pieces, bounds = [], np.zeros(len(starts) + 1, dtype=np.int64)
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if end - start > 1:
            piece = np.sort(values[start:end])
            fresh = np.empty(len(piece), dtype=bool)
            fresh[0] = True
            np.not_equal(piece[1:], piece[:-1], out=fresh[1:])
            piece = piece[fresh]
        else:
            piece = values[start:end]
        pieces.append(piece)
        bounds[i + 1] = bounds[i] + len(piece)
    return (np.concatenate(pieces) if pieces else values[:0]), bounds


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words of each row, ascending, and their ``n + 1`` offsets.

    A row with fewer words has its whole sequence as its only shingle, a row
    without words has none.
    """
    multiplier = np.uint64(0x9FB21C651E98DF25)
    counts = np.diff(offsets)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    value = np.full(len(hashes), size, dtype=np.uint64)
    for i in range(size):
        value *= multiplier
        value += padded[i:i + len(hashes)]
    for row in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        whole = int(counts[row])
        for h in hashes[offsets[row]:offsets[row + 1]].tolist():
            whole = (whole * int(multiplier) + h) % (1 << 64)
        value[offsets[row]] = whole
    value = mixed(value)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return distinct_by_row(value, offsets[:-1], offsets[:-1] + made)
