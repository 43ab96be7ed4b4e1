"""Vectorised word work on Arrow string columns: bounds, hashes and counts without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those bytes only ever stand
for themselves, so words of bytes and words of characters are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; temporary arrays take some 60 times as much.
BLOCK = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[0x41:0x5B] = BYTE_CODE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer text stands alone."""
    _, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (len(at) long)."""
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever it stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    code, out = BYTE_CODE_LOWER if lower else BYTE_CODE, np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # a single text of any length is hashed piece by piece
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * BLOCK, "right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _grow(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words that lie in one row, and the row of each; h in row order, before as of bounds()."""
    count = np.diff(before)
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        w = mix(w * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    row = np.repeat(np.arange(len(count)), count)
    same = row[: len(w)] == row[n - 1 :]
    return w[same], row[: len(w)][same]
