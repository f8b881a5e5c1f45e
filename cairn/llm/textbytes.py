"""Vectorised byte and word scans over Arrow string columns, for use inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two polynomial hashes, independent of each other: an odd base with its inverse, and a random odd 64-bit value per byte, so that
#: the polynomials have no structure of their own.
POLY = []
for _base, _seed in ((0x9E3779B97F4A7C15, 20240229), (0xD1342543DE82EF95, 20241013)):
    _values = np.random.default_rng(_seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    POLY.append((np.uint64(_base), np.uint64(pow(_base, -1, 1 << 64)), _values))
#: Bytes of text that are scanned at once, unless one text is longer; about ten 8-byte arrays of that length are in memory then.
SLICE = 1 << 18
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, poly: int = 0) -> np.ndarray:
    """Powers 0 to n - 1 of a base; those of a slice are kept, longer ones are not."""
    have = _powers.get((poly, inverse))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 2), POLY[poly][inverse], np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= SLICE + 2:
            _powers[poly, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash (uint64): every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray, poly: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = sum of value[data[t]] * base^t over i <= t < j; len(data) + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    term = POLY[poly][2][data]
    term *= powers(len(data), False, poly)
    np.cumsum(term, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, poly: int = 0) -> np.ndarray:
    """Hash of each data[start:end], the same wherever the bytes lie."""
    h = prefix[end] - prefix[start]
    h *= powers(len(prefix), True, poly)[start]
    return mix(h)


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a string column as (lo, hi, bytes, offsets of hi - lo + 1), at most `most` bytes
    unless one row alone is longer. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def freeing(run):
    """run(batches), after which the worker gives back to the system what its allocators hold but do not use. Workers live on between tasks, next to the executor's own memory."""

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return out


def batch_parts(batches: Iterator[pa.RecordBatch], *names: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes in the named string or binary columns (one row at least), so that what a task makes of a
    slice stays small however long the texts are."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for name in names:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), np.int64)
        ends = np.cumsum(size + 64)
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo, before = hi, int(ends[hi - 1])


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(start, end, document) of each maximal run of bytes that `table` marks; runs end with their document."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    prev = np.zeros(n + 1, bool)
    prev[1:] = inside[:n]
    cut = offsets[:-1][offsets[:-1] < n]
    start = inside & ~prev
    start[cut] |= inside[cut]
    end = prev & ~inside
    end[cut] |= prev[cut]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(hash per word, document per word, number of words before each document: one more than documents)."""
    starts, ends, doc = word_spans(data, offsets, table)
    h = span_hash(prefix_hash(data), starts, ends)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offsets) - 1), out=first[1:])
    return h, doc, first
