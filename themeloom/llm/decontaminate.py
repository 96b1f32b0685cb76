"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item is a bag of five-word shingles with repeats as weights, and has a SimHash
fingerprint.  A document is looked at in windows of as many words as an item has; one with fewer
words than the item, but enough to reach the similarity, is one window.  A window's fingerprint is
looked up in an index of the items' fingerprints of this size, which is split into ``BLOCKS`` blocks
of bits: fingerprints within ``RADIUS`` bits differ by at most ``NEAR`` bits in at least one block,
so listing each item under all block values that near finds every one of them.  Candidates are then
verified by the exact weighted similarity of the two bags: the sum of the lesser weights over the
sum of the greater.

Only windows that can reach the similarity get a fingerprint: two bags of n and m shingles that
reach it share at least s (n + m) / (1 + s) of them, and the number of a window's shingles that
occur in items of its size, counted with a filter of bits that has no false negatives, is no less
than that.

The filter has at most ``MOST_BITS`` bits whatever the benchmark's size; a crowded filter lets
more windows through and loses none.  Items, windows and candidates are joined as tables.

Words are runs of letters, digits and non-ASCII signs, A-Z in lower case.  Items or windows with
fewer than five words are one shingle.  Defined results: null or wordless texts and items match
nothing, nor do items without an item_id; equal items and repeated rows match row by row; without
items nothing matches; an empty
table gives an empty result; only doc_id, item_id and the texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.scan import BETWEEN_TERMS, mix, runs, word_hashes, words
from themeloom.llm.tables import by_id, documents, keyed_texts, query, slices
from themeloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 6
NEAR = 2
RADIUS = BLOCKS * (NEAR + 1) - 1
MOST_BITS = 1 << 25
BITS_PER_KEY = 64

# First bit and width of each block.
BLOCK_BITS = [(i * 64 // BLOCKS, (i + 1) * 64 // BLOCKS - i * 64 // BLOCKS) for i in range(BLOCKS)]


def simhash(shingles: np.ndarray) -> int:
    """Bits that are set in over half of the shingles, repeats counted."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    over = 2 * bits.sum(0, dtype=np.int64) > len(shingles)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def window_simhashes(shingles: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of shingles[start:start + n] for many starts, from running sums of bits."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    over = 2 * (sums[start + n] - sums[start]) > n
    return np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]


def sized(shingle: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes told apart by the size of the item that they stand in."""
    return mix(shingle ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, size, fp, shingles) of every item that has words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column("text"), BETWEEN_TERMS)
            hashes = word_hashes(found)
            out: list[list] = [[], [], [], []]
            ids = batch.column("item_id").to_pylist()
            for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(),
                                           strict=True)):
                if a == b:
                    continue
                k = min(SHINGLE, b - a)
                own, inside = runs(hashes[a:b], np.array([0, b - a]), k)
                own = own[inside]
                for column, value in zip(out, (ids[i], b - a, simhash(own), own.view(np.int64)),
                                         strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 pa.array(np.array(out[2], dtype=np.uint64).view(np.int64)),
                 pa.array(out[3], pa.list_(pa.int64()))],
                names=["item_id", "size", "fp", "shingles"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(
        F.col("text"), F.lit("")).alias("text")).filter("item_id is not null").mapInArrow(
        scan, "item_id long, size int, fp long, shingles array<long>")


class Filter:
    """Bits of the shingles of all items, and of those of each size; no false negatives."""

    def __init__(self, sizes: list[int], bits: int, words_: np.ndarray, values: np.ndarray):
        self.sizes, self.shift = sizes, np.uint64(64 - (bits.bit_length() - 1))
        self.table = np.zeros(bits // 64, dtype=np.uint64)
        self.table[words_] = values

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys) >> self.shift
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
                & np.uint64(1)).astype(bool)


def filter_of(items: DataFrame) -> Filter:
    """The bits are set by tasks and joined word by word; at most ``MOST_BITS`` come back."""
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    keys = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    bits = 1 << 12
    while bits < MOST_BITS and bits < BITS_PER_KEY * 2 * keys:
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros(bits // 64, dtype=np.uint64)
            for size, own in zip(batch.column("size").to_pylist(), batch.column("shingles"),
                                 strict=True):
                shingle = own.values.to_numpy().view(np.uint64)
                for keys in (shingle, sized(shingle, size)):
                    at = mix(keys) >> shift
                    np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64),
                                     np.uint64(1) << (at & np.uint64(63)))
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(table[at].view(np.int64))], names=["word", "bits"])

    got = items.select("size", "shingles").mapInArrow(scan, "word long, bits long").groupBy(
        "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    return Filter(sizes, bits, got.word.to_numpy().astype(np.int64),
                  got.bits.to_numpy().astype(np.int64).view(np.uint64))


def least_hits(n: int, similarity: float, m: int | None = None) -> int:
    """Shingles that bags of n and m (or n too) have in common at least if they are that similar."""
    both = n + (n if m is None else m)
    return int(np.ceil(similarity * both / (1 + similarity) - 1e-9))


def promising(hashes: np.ndarray, first: np.ndarray, seen: Filter, similarity: float) -> np.ndarray:
    """Rows where a stretch as long as the largest window has the hits that the smallest needs.

    A row shorter than the largest window may be a window by itself, which needs fewer.
    """
    n = len(hashes)
    length = np.repeat(np.diff(first), np.diff(first))
    found = np.zeros(n + 1, dtype=np.int64)
    for k in {min(SHINGLE, s) for s in seen.sizes}:
        counts = [s - k + 1 for s in seen.sizes if min(SHINGLE, s) == k]
        own, inside = runs(hashes, first, k)
        total = np.concatenate([[0], np.cumsum(inside & seen.has(own))])
        end = np.minimum(np.arange(n) + max(counts), n)
        least = min(counts)
        need = np.where(length < max(seen.sizes), int(np.ceil(similarity * least - 1e-9)),
                        least_hits(least, similarity))
        found[1:] |= total[end] - total[:-1] >= need
    found = np.cumsum(found)
    return np.flatnonzero(found[first[1:]] > found[first[:-1]])


def windows_of(hashes: np.ndarray, seen: Filter, similarity: float):
    """(start, size, fp, shingles) of the windows of one text that can match an item."""
    n = len(hashes)
    whole = np.array([0, n])
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in seen.sizes:
        k = min(SHINGLE, size)
        m = size - k + 1  # shingles of a window
        if size > n:
            if n < k or n - k + 1 < similarity * m - 1e-9:
                break
            m = n - k + 1
        if k not in kept:
            own, inside = runs(hashes, whole, k)
            own = own[inside]
            kept[k] = own, seen.has(own)
        own, any_ = kept[k]
        if not any_.any():
            continue
        need = least_hits(size - k + 1, similarity, m)
        hits = any_.copy()
        hits[any_] = seen.has(sized(own[any_], size))
        total = np.concatenate([[0], np.cumsum(hits)])
        start = np.flatnonzero(total[m:] - total[:-m] >= need)
        if len(start):
            lo, hi = int(start[0]), int(start[-1]) + m
            fps = window_simhashes(own[lo:hi], start - lo, m)
            for s, fp in zip(start.tolist(), fps.tolist(), strict=True):
                yield s, size, fp, own[s:s + m]


def candidate_windows(docs: DataFrame, seen: Filter, similarity: float) -> DataFrame:
    """(doc_id, start, size, fp, shingles) of all windows that can match an item."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), BETWEEN_TERMS)
                hashes = word_hashes(found)
                out: list[list] = [[], [], [], [], []]
                for i in promising(hashes, found.first, seen, similarity).tolist():
                    own = hashes[found.first[i]:found.first[i + 1]]
                    for window in windows_of(own, seen, similarity):
                        for column, value in zip(out, (i, *window), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(out[0], pa.int64())),
                     pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                     pa.array(np.array(out[3], dtype=np.uint64).view(np.int64)),
                     pa.array([x.view(np.int64) for x in out[4]], pa.list_(pa.int64()))],
                    names=["doc_id", "start", "size", "fp", "shingles"])

    return keyed_texts(docs).mapInArrow(
        scan, "doc_id long, start int, size int, fp long, shingles array<long>")


def _block(fp, i: int):
    first, width = BLOCK_BITS[i]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def item_index(items: DataFrame) -> DataFrame:
    """Each item's fingerprint under every value within ``NEAR`` bits of each of its blocks."""
    near = [F.expr(f"filter(sequence(0, {(1 << w) - 1}), x -> bit_count(x) <= {NEAR})")
            for _, w in BLOCK_BITS]
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias(
        "value"), near[i].alias("flips")) for i in range(BLOCKS)]))
    return items.select("item_id", "size", F.col("fp").alias("item_fp"), blocks.alias("b")).select(
        "item_id", "size", "item_fp", F.col("b.block").alias("block"),
        F.explode(F.transform("b.flips", lambda x: x.bitwiseXOR(F.col("b.value")))).alias("value"))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, size, hamming, similarity) of all windows that match an item.

    ``size`` counts the words of the window.
    """
    items = materialize(item_shingles(items))
    seen = filter_of(items)
    found = materialize(candidate_windows(docs, seen, similarity))
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias(
        "value")) for i in range(BLOCKS)]))
    probes = found.withColumn("b", blocks).select(
        "doc_id", "start", "size", "fp", "shingles", F.col("b.block").alias("block"),
        F.col("b.value").alias("value"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(True)  # a pair counts in the first block that finds it
    for i in range(BLOCKS):
        first &= (F.col("block") <= i) | (F.bit_count(_block(differ, i)) > NEAR)
    near = probes.join(item_index(items), ["size", "block", "value"]).filter(
        (F.bit_count(differ) <= RADIUS) & first).withColumn("hamming", F.bit_count(differ))
    pairs = near.select("doc_id", "item_id", "start", "size", "hamming", "shingles").join(
        items.groupBy("item_id", "size").agg(F.collect_set("shingles").alias("owns")),
        ["item_id", "size"])
    pairs = pairs.withColumn("size", (F.size("shingles") + F.least(F.lit(SHINGLE), F.col("size"))
                                      - 1).cast("int"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = []
            for mine, theirs in zip(batch.column("shingles"), batch.column("owns"), strict=True):
                a = Counter(mine.values.to_pylist())
                best = 0.0
                for own in theirs.values:
                    b = Counter(own.values.to_pylist())
                    best = max(best, (a & b).total() / (a | b).total())
                exact.append(best)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "item_id", "start", "size", "hamming")),
                 pa.array(exact, pa.float64())],
                names=["doc_id", "item_id", "start", "size", "hamming", "similarity"])

    return pairs.mapInArrow(verify, "doc_id long, item_id long, start int, size int, hamming int, "
                                    "similarity double").filter(F.col("similarity") >= similarity)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item: the window that is most like the item."""
    best = F.struct(F.col("similarity"), (-F.col("hamming")).alias("h"),
                    (-F.col("start")).alias("s"), (-F.col("size")).alias("z"))
    return matches(docs, items, similarity).groupBy("doc_id", "item_id").agg(
        F.max(best).alias("b")).select(
            "doc_id", "item_id", (-F.col("b.s")).alias("start_word"),
            (-F.col("b.z")).alias("n_words"), (-F.col("b.h")).alias("hamming"), "b.similarity")


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without a passage of ``items``; rows without a doc_id stay."""
    bad = contaminated(docs, items, similarity).select("doc_id").distinct()
    return by_id(docs, bad, "left_anti")


@query
def op6_decontamination(spark, sf_dir):
    """Documents that hold a passage of a benchmark item."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
