"""Texts as numpy arrays over their UTF-8 bytes: word bounds and hashes of words, windows and substrings.

A substring's hash is a polynomial over random 64-bit symbols modulo 2**64, read off prefix sums: the sum between two
ends, times the inverse power of the start. It is then mixed, so any of its bits may pick a bucket.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Texts longer than this are worked on in stretches of so many bytes, or of so many words.
STRETCH = 1 << 18
#: Stretches of bytes longer than this are hashed by BLAKE2.
LONG = 256

BYTES = np.arange(256, dtype=np.uint8)
#: A-Z become a-z; every other byte stays.
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, BYTES).astype(np.uint8)
#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


SYMBOL = mix((BYTES.astype(U64) + U64(1)) * U64(BASE))
SYMBOL_LOWER = SYMBOL[LOWER]

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n at least."""
    if len(_powers[0]) <= n:
        size = max(1 << 14, n + 1 + n // 4)
        for k, x in enumerate((BASE, INVERSE)):
            run = np.full(size, x, U64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=U64)
    return _powers[0], _powers[1]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """From 64-bit symbols, the n + 1 sums that span() reads."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], dtype=U64, out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), not mixed."""
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def windows(sums: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all windows of k symbols."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    return mix((sums[k:] - sums[:n]) * powers(n)[1][:n] + U64(k))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Of n places, those that some [start, start + length) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Mixed hashes of ascending, disjoint stretches of bytes, a stretch of them at a time. Long ones, for which a
    polynomial modulo 2**64 has strings that collide, are hashed by BLAKE2."""
    out = np.zeros(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, "right")))
        a, b = starts[first:last], ends[first:last]
        low = a[0]
        if last > first + 1 or b[0] - low <= LONG:
            out[first:last] = mix(span(prefix_sums(symbols[data[low : b[-1]]]), a - low, b - low) + (b - a).astype(U64))
        for k in np.flatnonzero(b - a > LONG).tolist():
            raw = data[a[k] : b[k]]
            out[first + k] = int.from_bytes(blake2b(LOWER[raw] if symbols is SYMBOL_LOWER else raw.tobytes(), digest_size=8).digest(), "little")
        first = last
    return out


def word_hashes(data: np.ndarray, is_word: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that is_word holds for."""
    starts, ends = runs(is_word[data])
    return starts, ends, hashes(data, starts, ends, symbols)


def windows_of(symbols: np.ndarray, k: int) -> np.ndarray:
    """windows() of 64-bit symbols, a stretch at a time."""
    n = len(symbols) - k + 1
    if n <= STRETCH:
        return windows(prefix_sums(symbols), k)
    return np.concatenate([windows(prefix_sums(symbols[a : min(a + STRETCH, n) + k - 1]), k) for a in range(0, n, STRETCH)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's n + 1 offsets into them, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's bytes."""
    data, at = utf8(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b]


#: glibc's numbers of two settings, and what workers set them to: larger arrays go back to the system as soon as they
#: are freed, and so does the end of the heap.
MMAP_THRESHOLD, TRIM_THRESHOLD = (-3, 4 << 20), (-1, 16 << 20)


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """malloc_trim, if this C library has it; its settings are made the first time."""
    lib = ctypes.CDLL(None)
    if hasattr(lib, "mallopt"):
        for which, value in (MMAP_THRESHOLD, TRIM_THRESHOLD):
            lib.mallopt(which, value)
    return getattr(lib, "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and their leavings would add up."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def released(run: Callable) -> Callable:
    """run, over the batches of a task, and then release()."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        yield from run(batches)
        release()

    return wrapped


def released_group(run: Callable) -> Callable:
    """The same of a function of a group's table."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return wrapped
