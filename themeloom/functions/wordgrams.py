"""Counted word n-grams of many texts, batch by batch; a text is counted in one pass over its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

# Rows that are handed on at once; one longer text is handed on by itself.
CHUNK = 1 << 18


def count_words(text: str, low: int, high: int, stopwords: frozenset[str]) -> Counter[str]:
    """N-grams of words longer than a letter; they are built after stop words have been left out."""
    tokens = [t for t in text.split(" ") if len(t) > 1 and t not in stopwords]
    return Counter(chain.from_iterable(
        tokens if n == 1 else map(" ".join, zip(*(tokens[i:] for i in range(n)), strict=False))
        for n in range(low, high + 1)))


def _counters(batch: pa.RecordBatch, text: str, low: int, high: int, stopwords: Sequence[str]
              ) -> Iterator[tuple[list[int], list[Counter[str]]]]:
    """Row numbers and counts of a batch, in parts of about ``CHUNK`` terms."""
    stops = frozenset(stopwords)
    rows: list[int] = []
    found: list[Counter[str]] = []
    size = 0
    for row, value in enumerate(batch.column(text)):
        found.append(count_words(value.as_py() or "", low, high, stops))
        rows.append(row)
        size += len(found[-1])
        if size >= CHUNK:
            yield rows, found
            rows, found, size = [], [], 0
    if rows:
        yield rows, found


def _columns(found: list[Counter[str]]) -> tuple[pa.Array, pa.Array]:
    return (pa.array(list(chain.from_iterable(found)), pa.string()),
            pa.array(list(chain.from_iterable(c.values() for c in found)), pa.int64()))


def counted_batches(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, low: int,
                    high: int, stopwords: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, term, tf) of batches with key columns and a text."""
    for batch in batches:
        for rows, found in _counters(batch, text, low, high, stopwords):
            at = pa.array(np.repeat(np.array(rows, np.int64), [len(c) for c in found]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in keys), *_columns(found)],
                names=[*keys, "term", "tf"])


def listed_batches(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, low: int,
                   high: int, stopwords: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(keys, terms, tfs): the same as one row for each text."""
    for batch in batches:
        for rows, found in _counters(batch, text, low, high, stopwords):
            ends = pa.array(np.cumsum([0, *(len(c) for c in found)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(rows, pa.int64())) for k in keys),
                 *(pa.ListArray.from_arrays(ends, c) for c in _columns(found))],
                names=[*keys, "terms", "tfs"])
