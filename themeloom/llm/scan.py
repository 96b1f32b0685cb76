"""Vectorised scanning of text batches: words, word hashes, runs of words, in numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Words are runs of bytes other than space, tab, line feed, vertical tab, form feed, return.
BETWEEN_WORDS = np.zeros(256, dtype=bool)
BETWEEN_WORDS[[32, *range(9, 14)]] = True

# The same with every ASCII character that is no letter or digit between words too.
BETWEEN_TERMS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


class Words(NamedTuple):
    """Words of a run of rows: lower-cased bytes, byte ranges, first word of each row (n + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and row offsets (n + 1); null rows are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=kind)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, between: np.ndarray = BETWEEN_WORDS) -> Words:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def _table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each of many ranges that rise and don't overlap."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    total = int(length.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    taken = values[inside + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)
    taken *= _table(int(length.max()))[inside]
    sums = np.add.reduceat(taken, np.cumsum(length) - length)
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(found: Words) -> np.ndarray:
    return range_hashes(found.data, found.start, found.end)


def runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k words in a row, by first word, and which of them stay inside a row."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    if n < k:
        return out, np.zeros(n, dtype=bool)
    table = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    for j in range(k):
        out[:n - k + 1] += hashes[j:n - k + 1 + j] * table[j]
    last = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n) + k <= last


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start:start + length] of many ranges, one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return pool[np.arange(total) + shift]
