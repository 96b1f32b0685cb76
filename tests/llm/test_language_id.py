from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.brute import odd_documents
from themeloom.llm import language_id as op
from themeloom.llm.tables import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_features_are_of_each_text_alone():
    x = op.features(pa.array(["Hello there", None, "", "12 !", "hello, THERE", "ab"]))
    assert np.allclose(x[0], x[4]) and not x[1:4].any()
    assert np.allclose(x[5], op.features(pa.array(["ab"]))[0])
    assert np.allclose((x[[0, 5]] ** 2).sum(1), 1)


def test_machine_parts_two_kinds():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 2] > 0.2, 1.0, -1.0)
    w = op.support_vector(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text",
                                        "if(id % 10 = 0, 'fr', 'en') as lang")
    got = {r.lang: r["count"] for r in op.sample(docs, 100, 150).groupBy("lang").count().collect()}
    assert got == {"en": 75, "fr": 75}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.identify(docs, F.lit(True)).collect()
    assert len(rows) == docs.count()
    names = {r.doc_id: r.lang_pred for r in rows}
    assert names[0] == names[1] == names[2] == names[9] == names[50] == "und" and names[5] == "en"
    assert {r.lang_pred for r in op.identify(docs, F.lit(False)).collect()} == {"und"}
    assert op.identify(odd_documents(spark, empty=True), F.lit(True)).count() == 0
