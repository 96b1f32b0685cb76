"""Passages that documents share, by seeds, collinear chains and alignment.

Marks are runs of ``SEED_WORDS`` words whose hash is the least of ``WINDOW`` neighbours; seeds are
all marks, and each mark with the next one and their distance.  Equal stretches of
``SEED_WORDS + WINDOW - 1`` words share a mark, so fuzzy passages need no longer ones; equal
stretches of ``SEED_WORDS + 2 * WINDOW - 1`` words share a pair of marks.  All occurrences of a seed
are joined to its first document (the least doc_id), never with each other: a seed in n documents
gives n - 1 matches.  Seeds are not written: texts are scanned once to find which are in several
documents, and again for the places of these; a filter of at most ``MOST_BITS`` bits leaves the
others out before the shuffle (a crowded filter lets more through and loses none).  Pairs of
documents with one match alone, mostly a common phrase, are looked at by the words around it before
their texts are joined; they go only if no alignment could make the match a passage.  The matches
of a pair of documents are chained: an anchor follows one that ends before it in both, at a cost for
the gap, and a Fenwick tree over the places in the other text finds the best predecessor.  Chains
are aligned word by word, in the gaps and beyond both ends, and what is long and alike enough is a
passage.  As ends are extended over the text itself, a passage is found whole although part of its
seeds may have another first document; and as a pair spans two marks, a passage put together from
two others has a seed of its own.

Words are runs of signs other than white space, A-Z in lower case.  Defined results: null, empty
and short texts share nothing; rows without a doc_id take no part; rows of equal doc_id are one
document, of which any one row is read; ties go to the least doc_id and place; repeats inside one
document alone are no passage; an empty table gives an empty result; only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.scan import mix, runs, word_hashes, words
from themeloom.llm.tables import documents, free_name, keyed_texts, query, slices
from themeloom.session import materialize

SEED_WORDS = 5
WINDOW = 16
LEAST_WORDS = 50
SIMILARITY = 0.8
GAP_COST = 0.1
# Unequal stretches longer than this end a passage.
MOST_GAP = 48
# Points that an extension may fall behind its best before it ends; a mismatch costs MISS.
DROP, MISS = 12, 2
# Words next to a lone match that may have to agree, and words of the other text they can lie in.
NEAREST = 20
AROUND = 48
# Of ids; bounds the list by which texts are left out before the shuffle.
BUCKETS = 1 << 20
# Of the filter of seeds in several documents.
MOST_BITS = 1 << 26
BITS_PER_KEY = 8


def minimizers(hashes: np.ndarray, first: np.ndarray, k: int = SEED_WORDS,
               window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds among all words, and their hashes; rows with fewer seeds than a window
    give their least one."""
    seeds, inside = runs(hashes, first, k)
    n = len(seeds)
    if not inside.any():
        return np.zeros(0, dtype=np.int64), seeds[:0]
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    rank = np.where(inside, seeds, worst)
    count = np.maximum(np.diff(first) - k + 1, 0)  # seeds of each row
    # least of the window that begins at each seed, by doubling; windows end with their row
    last = np.repeat(first[1:] - k, np.diff(first))
    least, width = rank.copy(), 1
    while width < window:
        step = min(width, window - width)
        moved = np.full(n, worst, dtype=np.uint64)
        moved[:max(n - step, 0)] = least[step:]
        moved[np.arange(n) + step > last] = worst
        least = np.minimum(least, moved)
        width += step
    # windows that reach their row's end are whole only if they begin no later than this
    begin = np.repeat(np.maximum(first[:-1], first[:-1] + count - window), np.diff(first))
    whole = inside & (np.arange(n) <= begin)
    # a seed is taken if it is the least of a window it stands in
    at = np.flatnonzero(whole)
    taken = np.zeros(n, dtype=bool)
    todo, shift = at, 0
    while len(todo):
        hit = rank[todo + shift] == least[todo]
        taken[todo[hit] + shift] = True
        todo = todo[~hit]
        shift += 1
    place = np.flatnonzero(taken)
    return place, seeds[place]


def seeds_of(docs: DataFrame, once: bool = False, seen: np.ndarray | None = None) -> DataFrame:
    """(seed, doc_id, pos) of all documents with an id: marks, and pairs of marks.

    ``once``: each seed of a document at its first place only.  ``seen``: only seeds whose bit is
    set in this table.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                place, mark = minimizers(word_hashes(found), found.first)
                row = np.searchsorted(found.first, place, side="right") - 1
                apart = (place[1:] - place[:-1]).astype(np.uint64)
                pair = mix(mark[:-1] ^ mix(mark[1:] + apart))
                paired = row[1:] == row[:-1]
                seed = np.concatenate([mark, pair[paired]])
                place = np.concatenate([place, place[:-1][paired]])
                row = np.concatenate([row, row[:-1][paired]])
                keep = np.arange(len(seed))
                if seen is not None:
                    keep = np.flatnonzero(_has(seen, seed))
                elif once and len(seed):
                    keep = np.lexsort((place, seed, row))
                    new = np.ones(len(keep), dtype=bool)
                    new[1:] = ((seed[keep[1:]] != seed[keep[:-1]])
                               | (row[keep[1:]] != row[keep[:-1]]))
                    keep = keep[new]
                seed, place, row = seed[keep], place[keep], row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), part.column("doc_id").take(pa.array(row)),
                     pa.array((place - found.first[row]).astype(np.int32))],
                    names=["seed", "doc_id", "pos"])

    return keyed_texts(docs).filter("doc_id is not null").mapInArrow(
        scan, "seed long, doc_id long, pos int")


def _bits(seed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each seed in a table of ``size`` words."""
    at = mix(seed) >> np.uint64(64 - (size.bit_length() + 5))
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def _has(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    word, bit = _bits(seed, len(table))
    return (table[word] & bit) != 0


def filter_of(seeds: DataFrame) -> np.ndarray:
    """Table of bits of all seeds, set by tasks and joined word by word."""
    n, bits = seeds.count(), 1 << 12
    while bits < MOST_BITS and bits < BITS_PER_KEY * n:
        bits *= 2
    size = bits // 64

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.uint64)
        for batch in batches:
            word, bit = _bits(batch.column("seed").to_numpy().view(np.uint64), size)
            np.bitwise_or.at(table, word, bit)
        at = np.flatnonzero(table)
        for k in range(0, len(at), 1 << 16):
            own = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(table[own].view(np.int64))], names=["word", "bits"])

    got = seeds.select("seed").mapInArrow(scan, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size, dtype=np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def _keys(doc_id: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64) ^ mix(pos.astype(np.uint64)))


def surroundings(docs: DataFrame, seen: np.ndarray) -> DataFrame:
    """(doc_id, pos, before, after): words around marks whose place has its bit in ``seen``, as
    16-bit hashes, from the mark outwards."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                hashes = word_hashes(found)
                place, _ = minimizers(hashes, found.first)
                row = np.searchsorted(found.first, place, side="right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                keep = np.flatnonzero(_has(seen, _keys(ids, place - found.first[row])))
                place, row = place[keep], row[keep]
                short = (hashes >> np.uint64(48)).astype("<u2")
                before, after = [], []
                for i, lo, hi in zip(place.tolist(), found.first[row].tolist(),
                                     found.first[row + 1].tolist(), strict=True):
                    before.append(short[max(lo, i - AROUND):i][::-1].tobytes())
                    after.append(short[i + SEED_WORDS:min(hi, i + SEED_WORDS + AROUND)].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array((place - found.first[row]).astype(np.int32)),
                     pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                    names=["doc_id", "pos", "before", "after"])

    return keyed_texts(docs).filter("doc_id is not null").mapInArrow(
        scan, "doc_id long, pos int, before binary, after binary")


def may_extend(a: bytes, b: bytes, least: int) -> bool:
    """Whether ``extend`` can go on ``least`` words in a, by the nearest words of both.

    It stops when its points, equal words less MISS for each word passed over, fall under -DROP; so
    of the first c words of a at least (MISS * c - DROP) / (MISS + 1) agree, in order, with some of
    b, and it is no further in b than these and the words passed over.
    """
    if len(a) < 2 * least:
        return False
    c = min(least, NEAREST)
    need = (MISS * c - DROP) / (MISS + 1)
    x, y = np.frombuffer(a, "<u2")[:c].tolist(), np.frombuffer(b, "<u2").tolist()
    return sum(w in y for w in x) >= need and _common(x, y) >= need


def promising(docs: DataFrame, lone: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, other_id) of rows (doc_id, other_id, pos, other_pos) whose match may be part of a
    passage; rows are the only match of their pair."""
    least = min(-(-(least_words - SEED_WORDS) // 2), AROUND)  # on one side at least

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("doc_id").to_numpy(), batch.column("pos").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["seed"])

    places = lone.select("doc_id", "pos").union(lone.select("other_id", "other_pos")).distinct()
    around = materialize(surroundings(docs, filter_of(materialize(
        places.mapInArrow(key, "seed long")))))
    other = around.select(*[F.col(c).alias(f"other_{c}") for c in ("pos", "before", "after")],
                          F.col("doc_id").alias("other_id"))
    both = lone.join(around, ["doc_id", "pos"]).join(other, ["other_id", "other_pos"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, d = (batch.column(x).to_pylist()
                          for x in ("before", "other_before", "after", "other_after"))
            may = [may_extend(a[i], b[i], least) or may_extend(c[i], d[i], least)
                   for i in range(len(a))]
            yield batch.select(["doc_id", "other_id"]).filter(pa.array(may, pa.bool_()))

    return both.mapInArrow(check, "doc_id long, other_id long").distinct()


def anchors(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, other_id, anchors): places of common seeds, for a document and a first one."""
    first = seeds_of(docs, once=True).groupBy("seed").agg(
        F.min("doc_id").alias("other_id"), F.min_by("pos", "doc_id").alias("other_pos"),
        F.max("doc_id").alias("last"))
    first = materialize(first.filter("other_id < last").drop("last"))
    seeds = seeds_of(docs, seen=filter_of(first))
    pairs = materialize(seeds.join(first, "seed").filter("doc_id <> other_id").groupBy(
        "doc_id", "other_id").agg(F.collect_set(F.struct("pos", "other_pos")).alias("anchors")))
    one = pairs.filter(F.size("anchors") == 1)
    lone = one.select("doc_id", "other_id", F.col("anchors")[0]["pos"].alias("pos"),
                      F.col("anchors")[0]["other_pos"].alias("other_pos"))
    kept = one.join(promising(docs, lone, least_words), ["doc_id", "other_id"], "left_semi")
    return pairs.filter(F.size("anchors") > 1).unionByName(kept)


class Segment(NamedTuple):
    """An equal stretch: place in one text, place in the other, words."""

    x: int
    y: int
    n: int


def segments(a: list, b: list, x: np.ndarray, y: np.ndarray, k: int = SEED_WORDS
             ) -> list[Segment]:
    """Anchors as stretches: neighbours on a diagonal with equal words between them become one."""
    order = np.lexsort((x, x - y))
    out: list[Segment] = []
    for u, v in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if out:
            s = out[-1]
            end = s.x + s.n
            if s.x - s.y == u - v and (u <= end or u - end <= MOST_GAP
                                       and a[end:u] == b[end - s.x + s.y:v]):
                out[-1] = Segment(s.x, s.y, max(s.n, u + k - s.x))
                continue
        out.append(Segment(u, v, k))
    return out


class Fenwick:
    """Greatest value, and its owner, over prefixes of places."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, owner)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        found = (-np.inf, -1)
        place += 1
        while place > 0:
            found = max(found, self.best[place])
            place -= place & -place
        return found


def chains(parts: list[Segment], gap_cost: float = GAP_COST) -> list[list[Segment]]:
    """Best chains of stretches that rise in both texts, best first, each stretch in one chain."""
    if len(parts) == 1:
        return [parts]
    parts = sorted(parts)
    ends = sorted({s.y + s.n for s in parts})
    place = {e: i for i, e in enumerate(ends)}
    starts = np.searchsorted(ends, [s.y for s in parts], side="right").tolist()
    by_end = sorted(range(len(parts)), key=lambda i: parts[i].x + parts[i].n)
    tree, score, back = Fenwick(len(ends)), [0.0] * len(parts), [-1] * len(parts)
    done = 0
    for i, s in enumerate(parts):
        while done < len(by_end) and parts[by_end[done]].x + parts[by_end[done]].n <= s.x:
            j = by_end[done]
            e = parts[j]
            tree.put(place[e.y + e.n], score[j] + gap_cost * (e.x + e.n + e.y + e.n), j)
            done += 1
        value, owner = tree.upto(starts[i] - 1)
        value -= gap_cost * (s.x + s.y)
        score[i] = s.n + max(value, 0.0)
        back[i] = owner if value > 0 else -1
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _common(a: list, b: list) -> int:
    """Longest common subsequence of two short stretches."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = last + 1 if x == y else max(here, row[j - 1])
            last = here
    return row[-1]


# Steps past a mismatch, in both texts: a word replaced, left out or put in, and two of them.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 0), (0, 2), (2, 1), (1, 2), (3, 3))


def extend(a: list, b: list, i: int, j: int, way: int) -> tuple[int, int, int]:
    """Words that the alignment goes on in a and in b from (i, j), and how many of them agree."""
    best = (0, 0, 0)
    points = top = equal = 0
    x, y, n, m = i, j, len(a), len(b)
    while 0 <= x < n and 0 <= y < m:
        if a[x] == b[y]:
            x, y, points, equal = x + way, y + way, points + 1, equal + 1
            if points > top:
                top, best = points, (abs(x - i), abs(y - j), equal)
            continue
        for s, t in _STEPS:
            u, v = x + way * s, y + way * t
            if all(0 <= u + w < n and 0 <= v + w < m and a[u + w] == b[v + w]
                   for w in (0, way, 2 * way)):
                x, y, points = u, v, points - MISS * max(s, t)
                break
        else:
            return best
        if points < top - DROP:
            return best
    return best


class Passage(NamedTuple):
    start: int
    words: int
    other_start: int
    other_words: int
    equal: int


def aligned(a: list, b: list, chain: list[Segment]) -> Iterator[Passage]:
    """Passages along a chain: stretches joined over gaps that align, both ends extended."""
    head, end = chain[0], None
    run: list = []
    for s in chain:
        if run:
            gap_a, gap_b = a[end[0]:s.x], b[end[1]:s.y]
            same = (len(gap_a) if gap_a == gap_b else
                    _common(gap_a, gap_b) if max(len(gap_a), len(gap_b)) <= MOST_GAP else -1)
            if same >= 0 and same * 2 >= max(len(gap_a), len(gap_b)) - 6:
                run[2] += same + s.n
                end = (s.x + s.n, s.y + s.n)
                continue
            yield _grown(a, b, run, end)
        run, end = [s.x, s.y, s.n], (s.x + s.n, s.y + s.n)
    yield _grown(a, b, run, end)


def _grown(a: list, b: list, run: list, end: tuple[int, int]) -> Passage:
    left = extend(a, b, run[0] - 1, run[1] - 1, -1)
    right = extend(a, b, end[0], end[1], 1)
    x, y = run[0] - left[0], run[1] - left[1]
    return Passage(x, end[0] + right[0] - x, y, end[1] + right[1] - y,
                   run[2] + left[2] + right[2])


def passages_of(a: list, b: list, x: np.ndarray, y: np.ndarray, least_words: int,
                similarity: float) -> list[Passage]:
    """Passages of a that are like one of b, none inside another."""
    out: list[Passage] = []
    for chain in chains(segments(a, b, x, y)):
        if any(p.start <= s.x and s.x + s.n <= p.start + p.words
               and p.other_start <= s.y and s.y + s.n <= p.other_start + p.other_words
               for p in out for s in (chain[0],)) and len(chain) == 1:
            continue
        for p in aligned(a, b, chain):
            if p.words >= least_words and p.equal >= similarity * max(p.words, p.other_words):
                out.append(p)
    return sorted(set(out))


def shared_passages(docs: DataFrame, least_words: int = LEAST_WORDS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start_word, n_words, other_id, other_start, other_words, equal_words, similarity).

    ``other_id`` is a lesser doc_id that holds the passage too, ``similarity`` the share of equal
    words in the longer of both.
    """
    return text_passages(docs, least_words, similarity).drop("text_hash")


def text_passages(docs: DataFrame, least_words: int = LEAST_WORDS,
                  similarity: float = SIMILARITY) -> DataFrame:
    """The same with ``text_hash`` of the text that a doc_id was read with."""
    pairs = materialize(anchors(docs, least_words))
    texts = keyed_texts(docs).filter("doc_id is not null")
    named = pairs.select("doc_id").union(pairs.select("other_id")).distinct()
    # no more than BUCKETS rows: what isn't in a bucket of a named document needn't be shuffled
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    buckets = named.select(bucket.alias("bucket")).distinct()
    texts = texts.join(F.broadcast(buckets), bucket == F.col("bucket"), "left_semi")
    texts = materialize(texts.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    other = texts.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other_text"))
    both = pairs.join(other, "other_id").join(texts, "doc_id").withColumn(
        "text_hash", F.xxhash64("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[Passage] = []
            lists = batch.column("anchors")
            at = lists.offsets.to_numpy()
            x = lists.values.field("pos").to_numpy().astype(np.int64)
            y = lists.values.field("other_pos").to_numpy().astype(np.int64)
            for i, (text, other_text) in enumerate(zip(
                    batch.column("text"), batch.column("other_text"), strict=True)):
                a = text.as_py().encode().lower().split()  # of bytes: ASCII only
                b = other_text.as_py().encode().lower().split()
                for p in passages_of(a, b, x[at[i]:at[i + 1]], y[at[i]:at[i + 1]], least_words,
                                     similarity):
                    rows.append(i)
                    found.append(p)
            index = pa.array(rows, pa.int64())
            columns = list(zip(*found, strict=True)) or [()] * 5
            first, n, second, m, equal = (pa.array(c, pa.int32()) for c in columns)
            share = [p.equal / max(p.words, p.other_words) for p in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("text_hash").take(index), first, n,
                 batch.column("other_id").take(index), second, m, equal,
                 pa.array(share, pa.float64())],
                names=["doc_id", "text_hash", "start_word", "n_words", "other_id", "other_start",
                       "other_words", "equal_words", "similarity"])

    return both.mapInArrow(align, "doc_id long, text_hash long, start_word int, n_words int, "
                                  "other_id long, other_start int, other_words int, equal_words int, "
                                  "similarity double")


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of some (first word, words) spans, nor the space after them."""
    found = words(pa.array([raw.decode()]))
    n = len(found.start)
    keep = np.ones(n + 1, dtype=bool)
    for first, size in spans:
        keep[first:first + size] = False
    keep[n] = True
    begin = np.append(found.start, len(raw))
    cut = np.zeros(len(raw) + 1, dtype=np.int64)
    gone = np.flatnonzero(~keep)
    np.add.at(cut, begin[gone], 1)
    np.add.at(cut, begin[gone + 1], -1)
    data = np.frombuffer(raw, dtype=np.uint8)
    return data[np.cumsum(cut[:-1]) == 0].tobytes()


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the passages that a document of lesser id holds too.

    The first document keeps a passage.  Of different texts with one doc_id one is read and cut, the
    others stay whole.  Documents of which no word is left go; all others stay,
    with the columns of ``docs``; where a text was cut, ``n_chars`` counts what is left of it.
    """
    spans = materialize(text_passages(docs, **options).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start_word", "n_words")).alias("spans")))
    id_, text_hash, listed = (free_name(docs, c) for c in ("cut_id", "cut_hash", "cut_spans"))
    spans = spans.toDF(id_, text_hash, listed)
    marked = docs.join(spans, (docs["doc_id"].cast("long") == spans[id_]) & (
        F.xxhash64(docs["text"]) == spans[text_hash]), "left")
    kept = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            stays = [True] * len(texts)
            counts = []
            if "n_chars" in kept and pa.types.is_integer(batch.schema.field("n_chars").type):
                counts = batch.column("n_chars").to_pylist()
            for i, spans_ in enumerate(batch.column(listed).to_pylist()):
                if spans_:
                    raw = without(texts[i].encode(),
                                  [(s["start_word"], s["n_words"]) for s in spans_])
                    texts[i], stays[i] = raw.decode(), bool(raw.split())
                    if counts and counts[i] is not None:
                        counts[i] = len(texts[i])
            new = {"text": texts, "n_chars": counts} if counts else {"text": texts}
            columns = [pa.array(new[c], batch.schema.field(c).type) if c in new
                       else batch.column(c) for c in kept]
            whole = pa.RecordBatch.from_arrays(columns, names=kept)
            yield whole.filter(pa.array(stays, pa.bool_()))

    return marked.select(*kept, listed).mapInArrow(cut, docs.schema)


@query
def op8_substring_dedup(spark, sf_dir):
    """Passages of at least 50 words that documents share, each with a first document."""
    return shared_passages(documents(spark, sf_dir))
