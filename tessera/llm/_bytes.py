"""Vectorised hashing over Arrow string columns: no Python loop over words.

A batch of texts is one byte buffer with offsets. Prefix sums of byte * base**i (modulo
2**64) give the polynomial hash of any byte range, so all word hashes of a batch, and
from them all hashes of runs of k words, come from a few array operations.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)  # arrays of a megabyte or more go back to the system when freed
except (OSError, AttributeError):  # another C library
    _libc = None

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes handled at once: bounds the temporary arrays, whatever the batch.
BLOCK = 1 << 19

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 ... base**(n-1) and the inverses."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _P), ("_inverse", _INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverse[:n]


def trim() -> None:
    """Give freed memory back: an executor's Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each range, mixed; the length counts too."""
    n = len(values)
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * power[:n], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    return raw, (at - at[0] if len(at) else np.zeros(1, np.int64))


def words(raw: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """Hashes of all words between ASCII white space and how many each text has, in order;
    also their byte ranges. ``fold`` lower-cases A-Z first."""
    raw = _FOLD[raw] if fold else raw
    solid = ~_SPACE[raw]
    # a word begins at a solid byte after a space, or at a text's first byte
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(raw)]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    inner = inner[(inner > 0) & (inner <= len(raw))] - 1
    after[inner] = False
    end = np.flatnonzero(solid & ~after) + 1
    hashes = range_hashes(raw.astype(np.uint64) + np.uint64(1), start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    return hashes, np.diff(first), start, end


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def runs(hashes: np.ndarray, counts: np.ndarray, width: int):
    """Hash of every run of ``width`` words inside one text: hashes, and how many each text has."""
    first = np.concatenate(([0], np.cumsum(counts)))
    n = np.maximum(counts - width + 1, 0)
    total = int(n.sum())
    ends = np.cumsum(n)
    start = np.arange(total) - np.repeat(ends - n, n) + np.repeat(first[:-1], n)
    return (range_hashes(hashes, start, start + width) if total else np.zeros(0, np.uint64)), n
