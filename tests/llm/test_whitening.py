"""Whitening against a library decomposition, exact integers and odd rows."""

import math

import numpy as np
import pytest

from casebase.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, deviation string, whitened int"


def table(spark, vectors, ids=None):
    rows = [(i, v, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def grid(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def test_like_a_library(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 3 + rng.normal(size=20) * 50).tolist()
    odd = [None, [], [1.0] * 19, [1.0] * 19 + [None], [float("nan")] + [1.0] * 19, [float("inf")] * 20, [1e300] * 20]
    given = data + odd + data[:40] + [data[0]] * 60
    df = table(spark, given)
    model = W.fit(df, components=16)
    x = np.array(sorted({tuple(grid(v)) for v in data}), dtype=float)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:16], vectors[:, ::-1].T[:16]
    assert model.n == len(x) and model.sums == [int(s) for s in x.sum(0)]
    assert np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(np.abs((model.components * vectors).sum(1)), 1, atol=1e-12)
    assert math.isclose(model.trace, cov.trace(), rel_tol=1e-14) and model.identity_error < 1e-10
    got = {r.vec_id: r for r in W.transform(df, model).collect()}
    assert sorted(got) == [i for i in range(len(given)) if not 300 <= i < 307]
    for i in (0, 5, 310, 360):
        exact = [int(a) - b for a, b in zip((np.array(grid(given[i])) * model.n).tolist(), model.sums, strict=True)]
        assert got[i].deviation == sum(d * d for d in exact)
        white = (model.components / np.sqrt(model.values)[:, None]) @ (np.array(grid(given[i])) - x.mean(0))
        assert np.allclose(got[i].whitened, white, atol=1e-9)


def test_centred_before_multiplying(spark):
    """A mean far above the spread costs no digits."""
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, size=(200, 6)).astype(float)
    near, far = W.fit(table(spark, base.tolist())), W.fit(table(spark, (base + 2.0**40).tolist()))
    assert np.allclose(near.values, far.values, rtol=1e-13) and far.identity_error < 1e-9


@pytest.mark.parametrize("top", [100, 2**25, 2**33, 2**45, 2**61])
def test_exact_products(top):
    y = np.random.default_rng(top % 97).integers(-top, top, (300, 4))
    assert (W._gram(y) == y.astype(object).T @ y.astype(object)).all()


def test_deviation_beyond_64_bits_is_null(spark):
    df = table(spark, [[1e15, 0.0], [-1e15, 1.0], [3.0, 2.0]])
    model = W.fit(df)
    got = {r.vec_id: r.deviation for r in W.transform(df, model).collect()}
    assert got[0] is None and got[1] is None and got[2] is None or got[2] < 2**63
    assert len(model.values) >= 1


def test_without_full_rank(spark):
    rng = np.random.default_rng(3)
    part = rng.integers(-50, 50, size=(100, 2)).astype(float)
    df = table(spark, [[a, b, a, b, 0.0] for a, b in part.tolist()])
    model = W.fit(df)
    assert len(model.values) == 2 and model.identity_error < 1e-10
    for rows in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        model = W.fit(table(spark, rows) if rows else spark.createDataFrame([], SCHEMA))
        assert len(model.values) == 0
        if model.n:
            got = W.transform(table(spark, rows), model).collect()
            assert [(r.deviation, r.whitened) for r in got] == [(0, [])] * len(rows)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (6, 6), (9, 4), (33, 33)):
        a = rng.normal(size=(50, rank)) @ rng.normal(size=(rank, d))
        cov = a.T @ a / 50
        factor, order = W.pivoted_cholesky(cov)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, cov[order][:, order])
        assert (np.triu(factor, 1) == 0).all()
        turned = W.one_sided_jacobi(factor)
        products = turned.T @ turned
        assert np.abs(products - np.diag(products.diagonal())).max() < 1e-12 * products.max()
