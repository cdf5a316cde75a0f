"""Vectorised text kernels over Arrow buffers: word bounds, polynomial hashes, sliding minima.

All hashes are 64-bit polynomials modulo 2**64 over a random byte table, finished by a mixer, so the hash of any
range follows from prefix sums in constant time. They depend on content alone and are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
pa.set_memory_pool(pa.system_memory_pool())  # returns freed batches, unlike the pooling default
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (xor-shift and multiply rounds)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
TABLE2 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i up to n at least."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((R, R_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * R**i, from which span() takes hashes."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), their length included."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets) of pieces of about limit bytes; a null is an empty text.

    A text is never cut, so a longer one makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()).fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each text, the number of words before it."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    closes = inside[:-1].copy()
    closes[:-1] &= ~inside[1:-1]
    lasts = cuts[1:] - 1
    closes[lasts] = inside[:-1][lasts]
    if len(closes):
        closes[-1] = inside[len(data) - 1]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, table: np.ndarray = TABLE) -> np.ndarray:
    return span(prefix(table[FOLD[data]] if fold else table[data]), starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of width consecutive values, the place of their least one (by its upper 34 bits; leftmost on ties)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = (values & ~np.uint64((1 << 30) - 1)) | np.arange(len(values), dtype=np.uint64)
    pad = -len(packed) % width
    block = np.concatenate([packed, np.full(pad, ~np.uint64(0), np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & np.uint64((1 << 30) - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
