"""Token counts by byte-pair merging with a heap and a linked list.

A text is normalised and cut as its tokenizer file says; each piece begins as a list of byte
symbols, the last with the end-of-word mark.  The adjacent pair of lowest rank is popped from a
heap, its two links become one, and the two new neighbours go onto the heap; what is left when no
pair has a rank is the count: symbols at first, less merges.  Nothing is turned into identifiers.

A task counts each distinct piece once as long as it remembers it; it forgets all pieces when
``REMEMBERED`` is reached, so memory is bounded and no result depends on it.

Defined results: null texts count as empty, empty texts have 0 tokens; strings of special tokens
inside a text are one token each, as the library does by default; repeated rows are counted row
by row; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.pieces import code_points, cut, distinct
from themeloom.llm.tables import documents, keyed_texts, query, slices

LIMIT = 2048
REMEMBERED = 400_000
_WHERE = (1 << 32) - 1


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class MergeTable:
    """Symbols of bytes, ranks of symbol pairs, and the symbols that they become."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        names: dict[str, int] = {}
        symbol = lambda name: names.setdefault(name, len(names))
        signs = byte_signs()
        self.inner = [symbol(s) for s in signs]
        self.final = [symbol(s + suffix) for s in signs]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(symbol(a) << 32 | symbol(b), i)
            self.result.append(symbol(a + b))

    def count(self, piece: bytes) -> int:
        """Symbols left of a piece."""
        n = len(piece)
        inner = self.inner
        symbols = [inner[b] for b in piece]
        symbols[-1] = self.final[piece[-1]]
        if n == 1:
            return 1
        rank, result = self.rank, self.result
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & _WHERE
            j = after[i]
            if j >= n or symbols[i] < 0 or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = result[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbols[i] << 32 | symbols[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] << 32 | symbols[i])
                if r is not None:
                    heappush(heap, r << 32 | h)
        return left


def normalised(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower-cased sign by sign, whatever stands after it
        return "".join(c.lower() for c in text)
    return text.lower()


class Counter:
    """Counts tokens of texts under one tokenizer file's content."""

    def __init__(self, spec: dict, remembered: int = REMEMBERED):
        self.table = MergeTable(spec)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))
                                  ) if special else None
        self.known: dict[int, int] = {}
        self.remembered = remembered

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if self.special and self.special.search(text):
                split = self.special.split(text)
                total[i] += len(split) - 1
            else:
                split = [text]
            parts += [normalised(p) for p in split]
            owner += [i] * len(split)
        whole, points, offsets = code_points(parts)
        begin, end = cut(points, offsets, lead_space=False)
        if not len(begin):
            return total
        index, hashes, place = distinct(points, begin, end)
        known, count = self.known, self.table.count
        sizes = np.zeros(len(hashes), dtype=np.int64)
        a, b = begin[place].tolist(), end[place].tolist()
        for i, h in enumerate(hashes.tolist()):
            n = known.get(h)
            if n is None:
                if len(known) >= self.remembered:
                    known.clear()
                n = known[h] = count(whole[a[i]:b[i]].encode())
            sizes[i] = n
        row = np.array(owner)[np.searchsorted(offsets, begin, side="right") - 1]
        return total + np.bincount(row, sizes[index], len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) under the tokenizer file ``tokenizer``."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    spec = {"model": {k: spec["model"][k] for k in ("merges", "end_of_word_suffix")},
            "added_tokens": spec["added_tokens"]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"),
                     pa.array(counter.counts(part.column("text").to_pylist()))],
                    names=["doc_id", "n_bytes", "n_tokens"])

    sized = keyed_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sized.mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


@query
def op4_token_counts(spark, sf_dir):
    """Tokens of every document under the word vocabulary."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
