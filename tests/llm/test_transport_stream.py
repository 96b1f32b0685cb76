from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.brute import odd_documents
from themeloom.llm import transport_stream as op
from themeloom.llm.tables import QUERIES


@pytest.mark.parametrize("n", [1, 64, 150, 161, 162, 163, 164, 345, 346, 347, op.UNIT - 1, op.UNIT,
                               op.UNIT + 1, 8 * op.UNIT, 20 * op.UNIT + 77])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    stream = op.write_stream(payload)
    assert len(stream) % 188 == 0 and (stream[::188] == 0x47).all()
    got = op.read_stream(stream)
    units = -(-n // op.UNIT)
    assert np.array_equal(got.samples, payload) and got.breaks == 0
    assert got.times.tolist() == [i * op.UNIT * op.TICKS for i in range(units)]
    assert np.flatnonzero(got.random).tolist() == list(range(0, units, op.RANDOM_EVERY))
    assert got.sizes.sum() == n


def test_damage_shows():
    payload = np.arange(30 * op.UNIT).astype(np.uint8)
    stream = op.write_stream(payload).reshape(-1, 188)
    lost = np.delete(stream, 40, axis=0).reshape(-1)
    assert op.read_stream(lost).breaks == 1
    broken = stream.copy()
    broken[:, 14][broken[:, 2] == 0] ^= 1  # the tables' bodies
    assert not len(op.read_stream(broken.reshape(-1)).samples)
    assert len(op.read_stream(stream[:0].reshape(-1)).samples) == 0


def test_checksum():
    assert op.table_checksum(b"123456789") == 0x0376E6E7


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op5_transport_stream"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stream = op.write_stream(np.frombuffer(payload, dtype=np.uint8)).tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert "breaks=0" in r.feature and "indexed=1" in r.feature


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.media_features(op.store(op.media_table(docs))).collect()
    assert len(rows) == docs.count()
    assert len({r[2:] for r in rows if r.doc_id in (0, 1, 50)}) == 1
    empty = op.media_table(odd_documents(spark, empty=True))
    assert op.media_features(op.store(empty)).count() == 0
