"""SimHash near-duplicate classes by a binary trie self-join.

A document's fingerprint has a bit set if it is set in over half of the hashes of its shingles.
Fingerprints that differ in at most ``budget`` bits are linked, and documents that are linked
through any number of steps form a class.

The join walks a binary trie of the distinct fingerprints: it goes down both nodes of a pair
together, adds up the bits in which their prefixes differ, and leaves a pair as soon as that is
more than the budget.  To deal the trie out, it is taken in ``budget + 1`` rotations of the bits:
of two linked fingerprints at least one of so many blocks is equal, so in the rotation that begins
with this block only a node with itself has to be followed through the first levels.  These nodes
are the tasks.  A node pair with too many fingerprints for one task goes down four more levels at
a time, into all child pairs within the budget, until every part is small; nothing is left out.

Defined results: null and empty texts, and texts of white space, have fingerprint zero, which links
like any other; texts with fewer words than a shingle are one shingle; equal rows get equal values,
row by row; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.components import components
from themeloom.llm.scan import text_bytes
from themeloom.llm.tables import by_id, documents, keyed_texts, query
from themeloom.session import materialize

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 2
# A node pair with more fingerprints than this is split further.
TASK_ROWS = 50_000
STEP = 4
# Node pairs that are expanded at once; bounds the memory of a task.
FRONT = 200_000

_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: bits set in over half of its shingles' hashes."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(found) - shingle_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(
        starts, ends[shingle_words - 1:].tolist(), strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            found = np.array([fingerprint(raw[a:b], shingle_words)
                              for a, b in zip(at, at[1:], strict=False)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return keyed_texts(docs).mapInArrow(scan, "doc_id long, fp long")


def _rotated(fp: Column, bits: int) -> Column:
    if not bits:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _unrotated(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bits = bits.astype(np.uint64)
    return np.where(bits == 0, values, (values >> bits) | (values << (np.uint64(64) - bits)
                                                           % np.uint64(64)))


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in a table of parents (each class by its least member)."""
    while len(i):
        a, b = parent[i], parent[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_join(values: np.ndarray, depth: int, pairs: np.ndarray, budget: int,
              parent: np.ndarray) -> None:
    """Join classes of values that differ in at most ``budget`` bits.

    ``values``: sorted runs of distinct 64-bit values, each run a subtree below ``depth``.
    ``pairs``: rows (lo, hi, lo2, hi2, spent): the ranges of two subtrees (or of one, twice) and
    the bits in which their prefixes differ.  Goes down both subtrees of a pair together.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, front = stack.pop()
        if len(front) > FRONT:
            stack += [(depth, front[k:k + FRONT]) for k in range(0, len(front), FRONT)]
            continue
        lone = ((front[:, 1] - front[:, 0]) == 1) & ((front[:, 3] - front[:, 2]) == 1)
        if depth >= 64:
            lone[:] = True
        leaf = front[lone]
        leaf = leaf[leaf[:, 0] != leaf[:, 2]]
        near = np.bitwise_count(values[leaf[:, 0]] ^ values[leaf[:, 2]]) <= budget
        _merge(parent, leaf[near, 0], leaf[near, 2])
        front = front[~lone]
        if not len(front):
            continue
        step = min(STEP, 64 - depth)
        shift = np.uint64(64 - depth - step)
        digit = ((values >> shift) & np.uint64((1 << step) - 1)).astype(np.int64)
        # children of every node in the front: runs of equal digits in its range
        nodes, index = np.unique(np.concatenate([front[:, :2], front[:, 2:4]]), axis=0,
                                 return_inverse=True)
        index = index.reshape(-1)
        length = nodes[:, 1] - nodes[:, 0]
        at = np.arange(int(length.sum())) + np.repeat(
            nodes[:, 0] - (np.cumsum(length) - length), length)
        owner = np.repeat(np.arange(len(nodes)), length)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digit[at[1:]] != digit[at[:-1]])
        lo = at[new]
        of = owner[new]
        kind = digit[lo]
        last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
        hi = at[last] + 1
        begin = np.searchsorted(of, np.arange(len(nodes) + 1))
        a, b = index[:len(front)], index[len(front):]
        n, m = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
        cells = n * m
        k = np.repeat(np.arange(len(front)), cells)
        inner = np.arange(len(k)) - np.repeat(np.cumsum(cells) - cells, cells)
        x, y = begin[a][k] + inner // m[k], begin[b][k] + inner % m[k]
        spent = front[k, 4] + _ONES[kind[x] ^ kind[y]]
        keep = (spent <= budget) & ((a[k] != b[k]) | (x <= y))
        single = (a[k] == b[k]) & (x == y) & (hi[x] - lo[x] == 1)
        keep &= ~single
        x, y, spent = x[keep], y[keep], spent[keep]
        if len(x):
            stack.append((depth + step, np.column_stack([lo[x], hi[x], lo[y], hi[y], spent])))


def _joined(table: pa.Table, budget: int) -> pa.RecordBatch:
    """Links inside the node pairs of a table that is sorted by node pair, side and value."""
    col = {c: table.column(c).to_numpy() for c in ("turn", "a", "b", "depth", "side", "v")}
    v = col["v"].view(np.uint64)
    n = len(v)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in ("turn", "a", "b", "depth"):
        change[1:] |= col[c][1:] != col[c][:-1]
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], n)
    right = np.add.reduceat((col["side"] == 1).astype(np.int64), lo)
    own = col["a"][lo] == col["b"][lo]
    # inside a run the values rise as unsigned numbers, the left side first
    order = np.lexsort((v, col["side"], np.cumsum(change)))
    v = v[order]
    parent = np.arange(n)
    spent = np.bitwise_count((col["a"] ^ col["b"]).view(np.uint64))[lo].astype(np.int64)
    mid = hi - right
    fits = np.where(own, hi - lo > 1, (mid > lo) & (mid < hi))
    pairs = np.column_stack([lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, spent])
    for depth in np.unique(col["depth"][lo]).tolist():
        trie_join(v, depth, pairs[fits & (col["depth"][lo] == depth)], budget, parent)
    linked = np.flatnonzero(parent != np.arange(n))
    bits = col["turn"][order]
    fp = _unrotated(v, bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(fp[linked].view(np.int64)), pa.array(fp[parent[linked]].view(np.int64))],
        names=["src", "dst"])


def _tasks(batches: Iterator[pa.RecordBatch], budget: int, rows: int):
    """Whole node pairs out of sorted batches; one that goes over a batch's end is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(c).to_numpy() for c in ("turn", "a", "b", "depth")]
        same = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            same &= k == k[-1]
        cut = table.num_rows - int(same[::-1].argmin() if not same.all() else table.num_rows)
        if cut:
            yield _joined(table.slice(0, cut).combine_chunks(), budget)
        held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield _joined(pa.Table.from_batches(held).combine_chunks(), budget)


def _descend(rows: DataFrame, budget: int) -> DataFrame:
    """Node pairs four levels down: every child pair within the budget."""
    step = F.least(F.lit(STEP), F.lit(64) - F.col("depth"))
    digit = F.expr(f"cast(shiftrightunsigned(v, 64 - depth - least({STEP}, 64 - depth)) "
                   f"& (shiftleft(1L, least({STEP}, 64 - depth)) - 1) as int)")
    left = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    rows = rows.withColumn("digit", digit).withColumn("left", F.lit(budget) - left).withColumn(
        "other", F.explode(F.expr(
            f"filter(sequence(0, cast(shiftleft(1L, least({STEP}, 64 - depth)) - 1 as int)), "
            "x -> bit_count(x ^ digit) <= left)")))
    own = F.col("a") == F.col("b")
    low, high = F.least("digit", "other"), F.greatest("digit", "other")
    mine = F.when(own, low).when(F.col("side") == 1, F.col("other")).otherwise(F.col("digit"))
    theirs = F.when(own, high).when(F.col("side") == 1, F.col("digit")).otherwise(F.col("other"))
    side = F.when(own, F.when(F.col("digit") <= F.col("other"), 0).otherwise(1)).otherwise(
        F.col("side"))
    wide = F.expr(f"cast(shiftleft(1L, least({STEP}, 64 - depth)) as bigint)")
    return rows.select("turn", (F.col("a") * wide + mine).alias("a"),
                       (F.col("b") * wide + theirs).alias("b"),
                       (F.col("depth") + step).cast("int").alias("depth"),
                       side.cast("int").alias("side"), "v")


def links(distinct: DataFrame, budget: int = BUDGET, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (src, dst) that span the classes of fingerprints within ``budget`` bits.

    ``distinct``: a column fp without repeats.  Each task gives at most one link for each row it
    reads, along which all fingerprints that it found linked hang together.
    """
    block = 64 // (budget + 1)
    turns = F.explode(F.array(*[F.struct(
        F.lit(i * block).alias("turn"), _rotated(F.col("fp"), i * block).alias("v"))
        for i in range(budget + 1)]))
    node = F.shiftrightunsigned("v", 64 - block)
    rows = distinct.select(turns.alias("t")).select("t.*").select(
        "turn", node.alias("a"), node.alias("b"), F.lit(block).alias("depth"),
        F.lit(0).alias("side"), "v")
    key = ["turn", "a", "b", "depth"]
    parts = []
    while True:
        hot = rows.groupBy(key).count().filter(
            (F.col("count") > task_rows) & (F.col("depth") < 64)).drop("count")
        hot = materialize(hot)
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, key, "left_anti"))
        rows = materialize(_descend(rows.join(hot, key, "left_semi"), budget))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    dealt = whole.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(lambda batches: _tasks(batches, budget, task_rows),
                            "src long, dst long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, budget: int = BUDGET,
                    task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the least doc_id that can be reached over links, the row's own included.
    Rows without a doc_id take part in links, but never name a class unless none has an id.
    """
    prints = materialize(fingerprints(docs, shingle_words))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    edges = materialize(links(distinct.select("fp"), budget, task_rows))
    roots = components(edges)
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id.

    Rows without a doc_id can't be told apart by it and all stay.
    """
    found = near_duplicates(docs, **options)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = by_id(docs.filter("doc_id is not null"), kept, "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))


@query
def op2_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")
