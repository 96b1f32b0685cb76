from __future__ import annotations

import numpy as np

from tests.llm.brute import odd_documents
from themeloom.llm import quality as op
from themeloom.llm.tables import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality_classifier"](spark, sf).collect()
    truth = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([p == t for p, t in held]) > 0.96


def test_violators_are_pooled():
    got = op.pool_violators(np.array([0, 3, 1, 0, 4.0]), np.array([2, 4, 4, 0, 4.0]))
    assert np.allclose(got, [0, 0.5, 0.5, 1, 1]) or np.allclose(got, [0, 0.5, 0.5, 0.5, 1])
    assert (np.diff(got) >= 0).all()


def test_ridge_leaves_each_fold_out():
    draw = np.random.default_rng(1)
    z = np.column_stack([draw.normal(size=(90, 4)), np.ones(90)])
    y = (z[:, 0] > 0).astype(float)
    fold = np.arange(90) % 3
    grams = np.array([z[fold == f].T @ z[fold == f] for f in range(3)])
    sums = np.array([z[fold == f].T @ y[fold == f] for f in range(3)])
    weights, without = op.ridge(grams, sums, np.array([y[fold == f].sum() for f in range(3)]),
                                np.full(3, 30), grid=(0.01,))
    penalty = np.diag([1, 1, 1, 1, 1e-9]) / 5
    assert np.allclose(weights, np.linalg.solve(z.T @ z + 0.9 * penalty, z.T @ y))
    rest = z[fold != 1]
    assert np.allclose(without[1], np.linalg.solve(rest.T @ rest + 0.6 * penalty,
                                                   rest.T @ y[fold != 1]))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(7, 1), (3, 0), (3, 0), (None, 1), (9, None), (99, 0)],
                                   "doc_id long, quality int")
    rows = op.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 50)}) == 1
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    none = labels.filter("false")
    assert {r.score for r in op.quality(docs, none).collect()} == {0.5}
    assert {r.score for r in op.quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    empty = odd_documents(spark, empty=True)
    assert op.quality(empty, labels).count() == 0 and op.keep_good(empty, labels).count() == 0
