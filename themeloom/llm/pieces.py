"""Vectorised cutting of texts into the pieces inside which byte-pair merging works.

Both published patterns are runs of letters, of numbers and of other signs, with English
contractions apart.  One lets a space lead a piece and keeps white space; the other takes numbers
one by one and leaves white space out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd

from themeloom.llm.scan import range_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of every code point."""
    if not _kinds:
        first = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER)
                             for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[list(_WHITE)] = SPACE
        _kinds.append(table)
    return _kinds[0]


def code_points(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one, its code points, and the offsets of the texts (n + 1)."""
    whole = "".join(texts)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64,
                                                         count=len(texts)))]).astype(np.int64)
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def cut(points: np.ndarray, offsets: np.ndarray, lead_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece.

    With ``lead_space`` a space belongs to the piece after it and other white space is kept;
    without, numbers stand alone and white space is left out.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = kinds()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    turn = start.copy()  # before spaces move over
    if lead_space:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    else:
        start |= kind == NUMBER
    # contractions: a lone apostrophe that begins a piece, and the letters after it
    at = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & turn[1:]
                        & ~edge[1:n])
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two = np.where(edge[np.minimum(at + 2, n)], 0, two)
        short = np.isin(one, [115, 116, 109, 100])  # s t m d
        pair = np.isin(one, [114, 118]) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        for found, size in ((at[short], 2), (at[pair & ~short], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    if not lead_space:
        solid = kind[begin] != SPACE
        begin, end = begin[solid], end[solid]
    return begin, end


def distinct(points: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Index of each piece among the distinct ones, their hashes, and a place of each."""
    index, hashes = pd.factorize(range_hashes(points, begin, end))
    place = np.zeros(len(hashes), dtype=np.int64)
    place[index[::-1]] = np.arange(len(index))[::-1]
    return index, hashes, place
