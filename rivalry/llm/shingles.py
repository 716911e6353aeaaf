"""Word shingles of whole texts as 64-bit hashes, straight from Arrow buffers.

Words are runs of characters other than ASCII blanks, A-Z lower-cased. A text with fewer
words than a shingle has its whole sequence as one shingle; without words it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Text bytes that are hashed at a time (a longer text is taken whole).
SLICE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, value in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            table = np.full(size, value, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array, limit: int = SLICE):
    """(first row, offsets, bytes) of consecutive rows with about ``limit`` bytes together."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, offsets[at:end + 1] - offsets[at], data[offsets[at]:offsets[end]]
        at = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] = hash of data[s:e] times BASE**s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], out=out[1:])
    return out


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct hashes) of every row, in order."""
    for at, offsets, data in slices(column):
        n = len(data)
        if not n:
            for i in range(len(offsets) - 1):
                yield at + i, np.empty(0, dtype=np.uint64)
            continue
        low = LOWER[data]
        inside = ~BLANK[low]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        p = prefix_hash(low)
        words = mix((p[ends] - p[starts]) * powers(n + 1)[1][starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, offsets)
        whole = _combine(words, k) if len(words) >= k else words[:0]
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a >= k:
                yield at + i, np.unique(whole[a:b - k + 1])
            else:
                yield at + i, _combine(words[a:b], b - a) if b > a else words[:0]


def _combine(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    acc = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        acc = mix(acc * U(31) + words[j:j + n])
    return acc
