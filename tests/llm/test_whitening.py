"""Whitening against numpy and against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from docmill.llm import whitening as w


def make(spark, vectors, start=0):
    rows = [(start + k, None if v is None else [None if x is None else float(x) for x in v], 7, "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, component string")


def plain(vectors):
    """Rising eigenvalues and their vectors of the entries' covariance."""
    x = np.floor(64 * np.array(vectors, float))
    c = x - x.mean(axis=0)
    return np.linalg.eigh(c.T @ c / len(x)), c


def test_equals_numpy(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(300, 40)) * np.linspace(0.3, 3, 40)
    got = w.whiten(make(spark, vectors.tolist() + [None, [1.0, None] + [0.0] * 38, [float("nan")] * 40, [float("inf")] * 40, [], [1.0] * 3])).collect()
    (values, basis), c = plain(vectors)
    assert len(got) == 300 * 32 and {r.n for r in got} == {300}
    z = np.zeros((300, 32))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    want = c @ basis[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-9
    assert np.abs(z.T @ z / 300 - np.eye(32)).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[k + 1] for k in range(32)], values[::-1][:32] / values.sum(), rtol=1e-12)
    x = np.floor(64 * vectors).astype(int) + 1_000_000
    sums = x.sum(axis=0)
    assert {r.vec_id: r.deviation for r in got} == {k: sum((300 * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for k, row in enumerate(x)}


def test_equal_eigenvalues_and_missing_dimensions(spark):
    # Unit vectors up and down: equal variance in six directions, more in the first with its double, none in the constant.
    vectors = [[3.0 * s * (j == k) for j in range(6)] + [1.0, 3.0 * s * (k == 0)] for k in range(6) for s in (1, -1)]
    rows, d = w.vectors(make(spark, vectors))
    model = w.fit(rows, d)
    assert np.allclose(model.variances, [12288, 6144, 6144, 6144, 6144, 6144]) and len(model.variances) == 6
    assert np.abs(model.components @ model.components.T - np.eye(6)).max() < 1e-14
    assert w.identity_error(rows, d, model) < 1e-12
    assert len(w.fit(rows, d, most=3).variances) == 3


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_no_variance_gives_no_rows(spark, vectors):
    out = w.whiten(make(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_huge_entries_repeated_rows_and_null_ids(spark):
    vectors = [[1e300, 1.0, -1e17], [0.5, 2.0, 1e17], [0.5, 2.0, 1e17], [3.0, -1e30, 0.25]]
    df = make(spark, vectors).unionByName(make(spark, vectors[:1]).selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding", "n", "component"))
    got = w.whiten(df).collect()
    assert {r.n for r in got} == {5} and sorted({-1 if r.vec_id is None else r.vec_id for r in got}) == [-1, 0, 1, 2, 3]
    assert all(r.deviation is None and math.isfinite(r.whitened) and r.identity_error < 1e-6 for r in got)


def test_polynomial_and_roots_are_exact(spark):
    rnd = random.Random(5)
    for d in (1, 2, 5, 9):
        b = [[rnd.randrange(-9, 10) for _ in range(d)] for _ in range(d)]
        m = [[sum(b[k][i] * b[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        f = w.characteristic(spark, m)
        for x in (-2, 0, 3):
            a = [[Fraction(x * (i == j) - m[i][j]) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for k in range(d):
                r = next((r for r in range(k, d) if a[r][k]), None)
                if r is None:
                    det = Fraction(0)
                    break
                if r != k:
                    a[k], a[r], det = a[r], a[k], -det
                det *= a[k][k]
                for i in range(k + 1, d):
                    by = a[i][k] / a[k][k]
                    a[i] = [p - by * q for p, q in zip(a[i], a[k], strict=True)]
            assert sum(c * x ** (d - k) for k, c in enumerate(f)) == det
    # (x - 1)^3 (x - 2) (x - 2.5)^2, times 4
    f = [1]
    for root in (1, 1, 1, 2, 5, 5):
        f = [a - root * b for a, b in zip(f + [0], [0] + f, strict=True)]
    assert [w.roots_above(f, x, 0) for x in (0, 1, 2, 4, 5)] == [6, 3, 2, 2, 0]
    g = w.simple_roots(f)
    assert g == [1, -8, 17, -10]
    assert [(r.low() < v <= r.high()) for r, v in zip(w.isolate(g, 16, 3), (5, 2, 1), strict=True)] == [True] * 3
