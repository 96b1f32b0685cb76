from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.brute import odd_documents
from themeloom.llm import packing as op
from themeloom.llm.tables import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = op.Encoder(PATH, remembered=60)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, capacity=2048):
    """Every piece is there once, with its ids, and sequences have no gap and no overlap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, rows_ in by_doc.items():
        own = np.array([*ids(texts[doc]), 0], dtype="<u4")
        copies = sum(r.piece == 0 for r in rows_)
        assert sum(r.length for r in rows_) == copies * len(own)
        for r in rows_:
            assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
            assert r.piece == 0 or r.length == capacity
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    sequences, total = check(rows, texts)
    assert sequences <= -(-total // 2048) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.text(max_size=40), st.text(alphabet="aB's'tr elv 12 .!\n\t  é", max_size=40),
    st.sampled_from(["<|endoftext|>", "x <|endoftext|>y", "'ll've 're 's\n\n 's", "  \n  ", " a",
                     "''s it's   x  "])), max_size=6))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got, at = ENCODER.ids(texts)
    assert [got[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids(t) for t in texts]


def fewest(lengths, capacity):
    """Least number of sequences, by trying all sets with the longest piece."""
    @cache
    def need(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            inside = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(inside) <= capacity:
                best = min(best, 1 + need(tuple(
                    rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best
    return need(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_an_optimum(lengths):
    counts = [0] * 21
    for x in lengths:
        counts[x] += 1
    fixed, rest = op.reduce_dominated(counts, 20)
    left = [x for x, n in enumerate(rest) for _ in range(n)]
    used = sum(n for n, _ in fixed)
    assert all(sum(x * t for x, t in content) <= 20 for _, content in fixed)
    assert used + fewest(left, 20) == fewest(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_has_a_place_for_each(lengths):
    counts = [0] * 65
    for x in lengths:
        counts[x] += 1
    rest = op.best_fit(counts, 64)
    for x in range(1, 65):
        assert sum(n * t for n, content in rest for y, t in content if y == x) == counts[x]
    assert all(sum(x * t for x, t in content) <= 64 for _, content in rest)
    places = op.plan(counts, 64)
    assert sum(places["times"] >= 1) == len(places["times"])


@pytest.mark.parametrize("part_rows", [2, 50_000])
def test_ranks(spark, part_rows):
    rows = spark.range(40).selectExpr("id as row", "id % 3 as length")
    got = op.ranked(rows, 40, part_rows).collect()
    for x in range(3):
        own = sorted(r.rank for r in got if r.length == x)
        assert own == list(range(len(own)))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.pack(docs, PATH).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert op.pack(odd_documents(spark, empty=True), PATH).count() == 0
