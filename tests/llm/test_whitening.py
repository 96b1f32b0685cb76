from __future__ import annotations

import math

import numpy as np
import pytest

from themeloom.llm import whitening as op
from themeloom.llm.tables import QUERIES


def brute(vectors):
    """x, its fit list and eigenvalues and unit eigenvectors of the covariance, falling."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    values, q = np.linalg.eigh(np.cov(u.T, bias=True))
    return x, u, values[::-1], q[:, ::-1]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    given = {r.vec_id: r.embedding for r in given if r.embedding is not None and all(
        c is not None and math.isfinite(c) for c in r.embedding)}
    ids = sorted(given)
    x, u, values, q = brute([given[i] for i in ids])
    n, sums = len(u), u.sum(0)
    rows = rows.sort_values(["vec_id", "component"])
    assert rows.vec_id.tolist() == np.repeat(ids, 16).tolist()
    assert set(rows.component) == set(range(1, 17)) and set(rows.n) == {n}
    assert (rows.deviation.to_numpy()[::16] == ((n * x - sums) ** 2).sum(1)).all()
    got = rows.whitened.to_numpy().reshape(-1, 16)
    want = (x - u.mean(0)) @ q[:, :16] / np.sqrt(values[:16])
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-8)
    assert np.allclose(rows.explained.to_numpy()[:16], values[:16] / values.sum(), rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9


@pytest.mark.parametrize("spread", [
    [9, 9, 9, 4, 4, 1, 1, 0, 0, 0], [5] * 10, [1e4, 1e3, 1e2, 10, 1, 1, 1e-1, 1e-2, 0, 0],
    [0] * 10, list(range(40, 0, -1))])
def test_singular_values_with_repeats(spread):
    d = len(spread)
    draw = np.random.default_rng(3)
    left, _ = np.linalg.qr(draw.normal(size=(80, d)))
    right, _ = np.linalg.qr(draw.normal(size=(d, d)))
    x = left * np.array(spread) @ right.T

    def product(y):
        u = x @ y
        return u @ u, x.T @ u

    values, vectors = op.singular(product, d, 4, np.linalg.norm(x))
    want = [s for s in sorted(spread, reverse=True)[:4] if s]
    assert np.allclose(values, want, rtol=1e-9)
    assert np.allclose(vectors @ vectors.T, np.eye(len(want)), atol=1e-9)
    assert np.allclose(np.linalg.norm(vectors @ x.T, axis=1), want, rtol=1e-9)


def test_stops_before_all_dimensions():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 300)) * 0.5 ** np.arange(300).clip(0, 40)
    calls = []

    def product(y):
        calls.append(1)
        u = x @ y
        return u @ u, x.T @ u

    values, _ = op.singular(product, 300, 4, np.linalg.norm(x))
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:4])
    assert len(calls) < 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.25, -3.0], [0.5, 1.25, -3.0], [2.0, 0.0, 1.0], [1e6, 4.0, 0.25], [7.0, 1.0],
            [-1.0, 2.0, 9.0]]
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1e300, 0.0, 0.0]]
    rows = [(i % 4 if i else None, v, i, "a") for i, v in enumerate(good + bad)]
    kind = "vec_id long, embedding array<double>, x int, component string"
    got = op.whiten(spark.createDataFrame(rows, kind)).toPandas()
    full = [v + [0.0] * (3 - len(v)) for v in good]
    x, u, values, q = brute(full)
    assert len(got) == 6 * 3 and set(got.n) == {5} and got.vec_id.isna().sum() == 3
    want = sorted(int(d) for d in ((5 * x - u.sum(0)) ** 2).sum(1))
    assert sorted(got.deviation[got.component == 1]) == want
    assert np.allclose(sorted(got.whitened.abs()),
                       sorted(np.abs((x - u.mean(0)) @ q / np.sqrt(values)).ravel()), atol=1e-8)
    for rest in ([], bad, good[:2], [[]], [[], None]):
        frame = spark.createDataFrame([(1, v, 0, "a") for v in rest], kind)
        assert op.whiten(frame).count() == 0
    one = spark.createDataFrame([(1, [3.0]), (2, [5.0])], "vec_id long, embedding array<float>")
    assert sorted(abs(r.whitened) for r in op.whiten(one).collect()) == [1.0, 1.0]


def test_wide_deviations():
    x = np.array([[2 ** 40, 1], [0, 0]])
    n = 2 ** 20
    assert op.exact_deviations(x, n, (0, 0)) == [None, 0]
    small = op.exact_deviations(x, 3, (2 ** 31, 5))
    assert small[1] == 2 ** 62 + 25 and small[0] is None
