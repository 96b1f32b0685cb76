"""Packing of tokenised documents into sequences, by dominance reduction and best fit.

Only the lengths of pieces matter for packing, and there are at most ``capacity`` of them: Spark
counts pieces by length, and the plan is made on these counts, whatever their number.

1. Dominance (Martello and Toth): a piece with a partner that fills its sequence exactly dominates
   every other set with this piece, as whatever else could stand beside it fits where the partner
   stood.  So does the largest partner that fits if no two others fit beside the piece, or if at
   most two do and the best two together are no longer than it; and the piece alone if nothing
   fits.  Such sets are fixed for good, until none is left.
2. Best fit: what remains goes, longest first, into the sequence with the least room that holds it.

Sequences of equal content are kept as one row with a number.  Pieces get ranks inside their
length, in parts so that no length is in one task, and a rank finds its place in the plan.

Defined results: null texts count as empty and give the end token alone; repeated rows are packed
row by row; documents longer than a sequence are cut so that only the first piece is shorter; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.pieces import code_points, cut, distinct
from themeloom.llm.scan import gather
from themeloom.llm.tables import documents, keyed_texts, query, slices
from themeloom.llm.token_count import byte_signs
from themeloom.session import materialize

CAPACITY = 2048
END_ID = 0
PART_ROWS = 50_000
# Pieces that a task remembers the ids of, and ids.
REMEMBERED = 400_000


# ---------------------------------------------------------------------------------------- tokens

# The pattern of byte-level vocabularies with a leading space.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of texts under a byte-level tokenizer file, piece by distinct piece."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {s: b for b, s in enumerate(byte_signs())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = list(special)
        self.whole = Tokenizer.from_file(path)
        self.merger = tiktoken.Encoding(
            "file", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
                bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                if token not in special})
        [self.line] = self.merger.encode_ordinary("\n")
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.size = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, all at once: written one to a line, which never joins a piece."""
        lone = [i for i, p in enumerate(pieces) if p.isspace() or "\n" in p]
        lines = np.array(self.merger.encode_ordinary("\n".join(
            p for p in pieces if not (p.isspace() or "\n" in p))), dtype=np.uint32)
        breaks = np.concatenate([[-1], np.flatnonzero(lines == self.line), [len(lines)]])
        size = np.zeros(len(pieces), dtype=np.int64)
        solid = np.ones(len(pieces), dtype=bool)
        solid[lone] = False
        if solid.any():
            size[solid] = np.diff(breaks) - 1
        ids = [self.merger.encode_ordinary(pieces[i]) for i in lone]
        size[lone] = [len(x) for x in ids]
        start = np.zeros(len(pieces), dtype=np.int64)
        base = len(self.pool)
        if solid.any():
            start[solid] = base + breaks[:-1] + 1
        if lone:
            start[lone] = base + len(lines) + np.cumsum([0, *map(len, ids[:-1])])
        self.pool = np.concatenate([self.pool, lines,
                                    np.array([x for y in ids for x in y], dtype=np.uint32)])
        self.size = np.concatenate([self.size, size])
        self.start = np.concatenate([self.start, start])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their offsets (n + 1)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:  # strings of special tokens: as the library itself has them
            given = {i: np.array(self.whole.encode(texts[i], add_special_tokens=False).ids,
                                 dtype=np.uint32) for i in odd}
            rest, at = self.ids(["" if i in given else t for i, t in enumerate(texts)])
            parts = [given.get(i, rest[at[i]:at[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        whole, points, offsets = code_points(texts)
        begin, end = cut(points, offsets, lead_space=True)
        if not len(begin):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        index, hashes, place = distinct(points, begin, end)
        if len(self.slot) + len(hashes) > self.remembered:
            self.forget()
        listed, slot = hashes.tolist(), self.slot
        new = [i for i, h in enumerate(listed) if h not in slot]
        if new:
            a, b = begin[place[new]].tolist(), end[place[new]].tolist()
            self._learn([whole[s:e] for s, e in zip(a, b, strict=True)])
            for i in new:
                slot[listed[i]] = len(slot)
        slots = np.array([slot[h] for h in listed], dtype=np.int64)[index]
        sizes = self.size[slots]
        row = np.searchsorted(begin, offsets)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.pool, self.start[slots], sizes), total[row]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
               end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encoder.ids(part.column("text").to_pylist())
                rows, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    first = n % capacity or capacity
                    for k, s in enumerate([0, *range(first, n, capacity)]):
                        e = min(n, first if not k else s + capacity)
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(own[s:e].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_texts(docs).mapInArrow(
        scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------------------------------ plan

# A group of sequences with equal content: how many, and (length, times) in order.
Group = tuple[int, tuple[tuple[int, int], ...]]


def reduce_dominated(counts: list[int], capacity: int) -> tuple[list[Group], list[int]]:
    """Sets that dominate all others with their longest piece, and the counts that are left."""
    counts = list(counts)
    fixed: list[Group] = []

    def fix(n: int, *lengths: int) -> None:
        fixed.append((n, tuple((x, 1) for x in lengths)))
        for x in lengths:
            counts[x] -= n

    def smallest(besides: int, n: int) -> list[int]:
        """The n smallest pieces, without one of length ``besides``."""
        out: list[int] = []
        for x in range(1, capacity + 1):
            out += [x] * min(n - len(out), counts[x] - (x == besides))
            if len(out) == n:
                break
        return out

    def best_two(room: int, besides: int) -> int:
        """Most that two pieces can fill of ``room``, without one of length ``besides``."""
        own = [counts[x] - (x == besides) for x in range(room + 1)]
        there = [x for x in range(1, room + 1) if own[x] > 0]
        best, low, high = 0, 0, len(there) - 1
        while low <= high:
            total = there[low] + there[high]
            if total > room or low == high and own[there[low]] < 2:
                high -= 1
            else:
                best = max(best, total)
                low += 1
        return best

    changed = True
    while changed:
        changed = False
        for x in range(capacity, 0, -1):
            while counts[x]:
                room = capacity - x
                if not room:
                    fix(counts[x], x)
                elif counts[room] > (room == x):
                    fix(min(counts[x], counts[room]) if room != x else counts[x] // 2, x, room)
                else:
                    partner = next((y for y in range(min(room, capacity), 0, -1)
                                    if counts[y] > (y == x)), 0)
                    if not partner:
                        fix(counts[x] if 2 * x > capacity else 1, x)
                    elif partner == x:
                        break  # longer sets of equal pieces: left to best fit
                    else:
                        small = smallest(x, 3)
                        one = len(small) < 2 or small[0] + small[1] > room
                        two = len(small) < 3 or sum(small) > room
                        if not (one or two and best_two(room, x) <= partner):
                            break
                        fix(min(counts[x], counts[partner]), x, partner)
                changed = True
    return fixed, counts


def best_fit(counts: list[int], capacity: int) -> list[Group]:
    """Longest first, each piece into the sequence with the least room that holds it."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, group: Group) -> None:
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append(group)

    for x in range(capacity, 0, -1):
        left = counts[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                room, have, content = capacity, left, ()
            else:
                room = rooms[at]
                have, content = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            each = room // x
            filled = min(have, left // each)
            if filled:
                put(room - each * x, (filled, (*content, (x, each))))
                left -= filled * each
                have -= filled
            if left and have and left < each:
                put(room - left * x, (1, (*content, (x, left))))
                have, left = have - 1, 0
            if have and content:
                put(room, (have, content))
    return [g for room in rooms for g in by_room[room]]


def plan(counts: list[int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places for every length: ranks from ``rank`` on go to sequences from ``sequence`` on.

    Arrays sorted by length and rank: length, rank, sequence, offset, and times, the number of
    places that one sequence has side by side there.
    """
    fixed, rest = reduce_dominated(counts, capacity)
    rank = [0] * (capacity + 1)
    rows, base = [], 0
    for n, content in fixed + best_fit(rest, capacity):
        offset = 0
        for x, times in content:
            rows.append((x, rank[x], base, offset, times))
            rank[x] += n * times
            offset += x * times
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "times"), table.T, strict=True))


def ranked(pieces: DataFrame, n_rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` with the rank of each inside its length, from 0.

    A length is dealt into parts by row, ranked inside them, and moved by the sizes of the parts
    before, so that a length with most of the rows isn't sorted in one task.
    """
    parts = max(1, -(-n_rows // part_rows))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    own = Window.partitionBy("length", "part").orderBy("row")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("own", F.row_number().over(own) - 1).join(
        sizes, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop(
            "own", "before", "part")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id).withColumn(
        "row", F.monotonically_increasing_id()))
    counts = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():  # one row for each length at most
        counts[r["length"]] = r["count"]
    places = plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(places["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for x, run in zip(*_runs(length[order]), strict=True):
                mine = order[run]
                a, b = begin[x], begin[x + 1]
                at[mine] = a + np.searchsorted(places["rank"][a:b], rank[mine], "right") - 1
            inside = rank - places["rank"][at]
            times = places["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.array(places["sequence"][at] + inside // times),
                 pa.array(places["offset"][at] + inside % times * length)],
                names=[*names, "sequence_id", "offset"])

    return ranked(pieces, sum(counts)).select(*names, "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
               "sequence_id long, offset long")


def _runs(ordered: np.ndarray) -> tuple[list[int], list[slice]]:
    """Values and slices of the runs of equal values."""
    lo = np.flatnonzero(np.diff(ordered, prepend=-1))
    hi = np.append(lo[1:], len(ordered))
    return ordered[lo].tolist(), [slice(a, b) for a, b in zip(lo, hi, strict=True)]


@query
def op10_best_fit_packing(spark, sf_dir):
    """All documents, packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
