"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    found = WORD.findall((text or "").encode().translate(
        bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not found:
        return 0
    grams = [b" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[int], ids: list[int], budget: int = 2) -> list[int]:
    """Least id reachable over fingerprints within ``budget`` bits, for each row."""
    values = sorted(set(prints))
    at = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bits = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(bits ^ np.uint64(v)) <= budget).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for v, k in zip(prints, ids, strict=True):
        root = find(at[v])
        least[root] = min(k, least.get(root, k))
    return [least[find(at[v])] for v in prints]


# Columns that operators use inside, to clash with.
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, "
              "row string, size int, component_id string, seed string, score string, x int, "
              "word string, part string, _row int, shingles string, anchors int, _bad int")


def odd_documents(spark, empty: bool = False):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    passage = " ".join(f"shared{i} piece{i * 7 % 13}" for i in range(40))
    long = "Lorem ipsum dolor sit amet, consectetur. " * 6000
    texts = [None, "", " \t\n", "a", "A", long, long, f"start of one {passage} end of one",
             f"another beginning {passage} and ending", "12345 !!! ???", "x" * 30000, "ß Σ İ 中文 \x00"]
    rows = [(i, t, "en", "src0", len(t or ""), *["z", "z", 1, "z", "z", "z", 1, "z", "z", 1, "z", 1,
                                               1]) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here", None, None, None, *[None] * 13),
             (50, None, *[None] * 16)]
    return spark.createDataFrame([] if empty else rows, ODD_SCHEMA)
