from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from tests.llm.brute import odd_documents
from themeloom.llm import sharding as op
from themeloom.llm.tables import QUERIES


def check(rows, texts, shards):
    by_shard = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        by_shard[r.shard].append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    share = sum(r.size for r in rows) / shards
    slack = 2 * max(r.size for r in rows) + 0.02 * share
    assert all(abs(sum(r.size for r in own) - share) <= slack for own in by_shard.values())
    return by_shard


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op9_sampled_splitters"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert len(check(rows, texts, 24)) == 24


def test_copies_of_one_row(spark):
    rows = [(1, "same text")] * 600 + [(2, "same text")] * 300 + [(i, f"t{i}") for i in range(9, 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.shard(docs, 4).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and len(check(got, texts, 4)) == 4


def test_hot_text(spark, monkeypatch):
    """Half of the rows are empty texts, few bytes in all; no task sorts more than its bound."""
    monkeypatch.setattr(op, "RANGE_ROWS", 500)
    docs = spark.range(12000).selectExpr(
        "id as doc_id", "if(id % 2 = 0, '', repeat(string(id), 40)) as text")
    rows = op.keyed(docs)
    total = rows.agg({"size": "sum"}).first()[0]
    cells = op.ranged(rows, 24, total).groupBy("range", "part", "hot", "piece").count().collect()
    assert max(c["count"] for c in cells) <= 2 * 500 and any(c.hot is not None for c in cells)
    got = op.shard(docs, 4).collect()
    check(got, {r.doc_id: r.text for r in docs.collect()}, 4)
    # 48,000 of 1.2 million bytes are more than a hundredth of a shard, so the copies may be parted,
    # but they stay neighbours: they lie in one stretch of the order
    assert len({r.shard for r in got if r.size == 8}) <= 2
    few = op.shard(spark.range(12000).selectExpr(
        "id as doc_id", "if(id % 2 = 0, '', repeat(string(id), 4000)) as text"), 4).collect()
    assert len({r.shard for r in few if r.size == 8}) == 1  # below a hundredth: together


def test_ranges_hold_the_order(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', int(id % 50)) as text")
    rows = op.keyed(docs)
    got = op.ranged(rows, 40, 2000 * 33).collect()
    key = lambda r: (r.k1, r.k2, r.row)
    ends = sorted((min(map(key, own)), max(map(key, own)), n) for n in {r.range for r in got}
                  if (own := [r for r in got if r.range == n]))
    assert [e[2] for e in ends] == sorted(e[2] for e in ends) and len(ends) > 20
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.shard(docs, 3).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, 3)
    assert len(rows) == docs.count()
    assert op.shard(odd_documents(spark, empty=True)).count() == 0
