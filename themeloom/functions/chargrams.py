"""Counted character n-grams of many texts at once, as array operations on their code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = 32
# Code points that are worked on at once; one longer text is taken by itself.
CHUNK = 1 << 20
HASH_CHUNK = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def count_grams(texts: list[str], low: int, high: int
                ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, n-gram, count) arrays for each size; words are cut at blanks and padded with one.

    With a blank around each text, padded words are stretches of it, so an n-gram is a window
    without a blank inside, and not two blanks.
    """
    joined = "".join(f" {t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    alphabet, code = np.unique(points, return_inverse=True)
    code = code.reshape(-1).astype(np.int64)
    blank = points == BLANK
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    for n in range(low, high + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        if n == 1:
            edge = np.flatnonzero(blank)
            solid = ~blank
            before = edge[np.append(solid[1:], False)[edge]]
            after = edge[np.append(False, solid[:-1])[edge]]
            at = np.concatenate([np.flatnonzero(solid), before, after])
        else:
            inside = np.zeros(m, dtype=bool)
            for j in range(1, n - 1):
                inside |= blank[j:j + m]
            if n == 2:
                inside = blank[:m] & blank[1:]
            at = np.flatnonzero(~inside)
        if not len(at):
            continue
        grams = np.stack([code[at + j] for j in range(n)], axis=1)
        shift = n * bits
        if shift + len(texts).bit_length() < 63:
            key = row[at]
            for j in range(n):
                key = key << bits | grams[:, j]
            key, first, count = np.unique(key, return_index=True, return_counts=True)
        else:  # many signs or long n-grams: by rank, one sign after the other
            key = row[at]
            for j in range(n):
                _, key = np.unique(key * len(alphabet) + grams[:, j], return_inverse=True)
                key = key.reshape(-1)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
        found = np.ascontiguousarray(alphabet[grams[first]]).view(f"<U{n}")[:, 0]
        yield row[at][first], found, count


def _parts(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of stretches of about ``most`` code points."""
    texts = batch.column(text).to_pylist()
    start = size = 0
    cuts = [0]
    for i, t in enumerate(texts):
        size += len(t or "") + 2
        if size > most and i > start:
            cuts.append(i)
            start, size = i, len(t or "") + 2
    for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
        yield a, [t or "" for t in texts[a:b]]


def hashed_grams(texts: list[str], low: int, high: int
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram hashes, counts) of each text: the n-grams of ``count_grams`` (``low`` above 1) as
    64-bit hashes, distinct and rising."""
    joined = "".join(f" {t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    blank = points == BLANK
    found = []
    for n in range(low, high + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        inside = np.zeros(m, dtype=bool)
        for j in range(1, n - 1):
            inside |= blank[j:j + m]
        if n == 2:
            inside = blank[:m] & blank[1:]
        at = np.flatnonzero(~inside)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ points[at + j]) * _FACTOR
            h ^= h >> np.uint64(32)
        h = (h * _FACTOR).view(np.int64)
        # windows lie inside a text: across two of them there are two blanks
        found.append((h, np.concatenate([[0], np.searchsorted(at, ends)])))
    for i in range(len(texts)):
        yield np.unique(np.concatenate([np.zeros(0, np.int64),
                                        *(h[to[i]:to[i + 1]] for h, to in found)]),
                        return_counts=True)


def hashed_batches(batches: Iterator[pa.RecordBatch], text: str, low: int, high: int
                   ) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Stretches of the batches and the ``hashed_grams`` of their rows."""
    for batch in batches:
        for a, part in _parts(batch, text, HASH_CHUNK):
            yield batch.slice(a, len(part)), list(hashed_grams(part, low, high))


def counted_batches(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, low: int,
                    high: int) -> Iterator[pa.RecordBatch]:
    """(keys, term, tf) of batches with key columns and a text."""
    for batch in batches:
        for a, part in _parts(batch, text):
            for row, term, count in count_grams(part, low, high):
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in keys),
                     pa.array(term.tolist(), pa.string()), pa.array(count, pa.int64())],
                    names=[*keys, "term", "tf"])


def listed_batches(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, low: int,
                   high: int) -> Iterator[pa.RecordBatch]:
    """(keys, terms, tfs): the same as one row for each text."""
    for batch in batches:
        for a, part in _parts(batch, text):
            row, term, count = [np.zeros(0, np.int64)], [pa.array([], pa.string())], []
            for r, t, c in count_grams(part, low, high):
                row.append(r)
                term.append(pa.array(t.tolist(), pa.string()))
                count.append(c)
            rows = np.concatenate(row)
            order = np.argsort(rows, kind="stable")
            ends = pa.array(np.searchsorted(rows[order], np.arange(len(part) + 1)), pa.int32())
            tfs = np.concatenate([np.zeros(0, np.int64), *count])[order]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(a, len(part)) for k in keys),
                 pa.ListArray.from_arrays(ends, pa.concat_arrays(term).take(pa.array(order))),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=[*keys, "terms", "tfs"])
