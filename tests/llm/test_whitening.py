import math

import numpy as np
import pytest

from driftloom.llm import whitening
from driftloom.llm.shared import Scratch, table

KIND = "vec_id long, embedding array<float>, id string, x int"


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(-50, 50, (6, 9)).astype(object)
    a = b @ b.T
    poly = whitening.characteristic_polynomial(spark, a)
    want = np.poly(a.astype(float))[::-1]
    assert poly[-1] == 1 and poly[-2] == -int(np.trace(a))
    assert np.allclose(np.array(poly, float), want, rtol=1e-9)
    roots = whitening.largest_roots(poly, 6)
    assert np.allclose([r / 2**whitening.FRACTION for r in roots], np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-10)


def test_equal_roots_have_a_basis_across_each_other(spark):
    a = np.diag(np.array([7, 7, 7, 2, 0], object))
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, a), 4)
    assert [r >> whitening.FRACTION for r in roots] == [7, 7, 7, 2]
    axes = whitening.components(a, roots)
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-14)
    assert np.allclose(a.astype(float) @ axes, axes * [7, 7, 7, 2], atol=1e-13)


def test_scatter_of_large_entries_is_exact(spark):
    rows = [[3 << 40, -5], [-(7 << 50), 1 << 61], [12, -(1 << 62)], [0, 0]]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<long>")
    n, sums, a = whitening.scatter(fit, 2)
    assert n == 4 and sums == [sum(r[k] for r in rows) for k in range(2)]
    for i in range(2):
        for j in range(2):
            assert a[i, j] == 4 * sum(r[i] * r[j] for r in rows) - sums[i] * sums[j]


def test_query_against_numpy(spark, sf):
    got = whitening.op13_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect())
    x = np.floor(256 * np.array([v for _, v in rows], float))
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert list(got.vec_id) == [i for i, _ in rows for _ in range(4)] and set(got.component) == {1, 2, 3, 4}
    assert np.allclose(np.abs((x - fit.mean(0)) @ vectors / np.sqrt(values)), np.abs(got.whitened.to_numpy().reshape(-1, 4)), atol=1e-9)
    assert np.allclose(got.explained[:4], values / np.trace(np.cov(fit.T, bias=True)), rtol=1e-9)
    n, sums = len(fit), fit.sum(0)
    assert set(got.n) == {n} and list(got.deviation[::4]) == [int(d) for d in ((n * x - sums) ** 2).sum(1)]
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_odd_rows(spark):
    bad = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2], "a", 1), (1, [0.1, 0.2], "a", 1), (2, [0.9], "b", 2), (None, [0.5, -0.3], None, None), (3, None, "c", 3),
        (4, [0.1, bad[0]], "d", 4), (5, [bad[1], 0.0], "e", 5), (6, [None, 1.0], "f", 6), (7, [], "g", 7),
    ]
    found = whitening.whitened(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted((i, k) for i in (0, 1, 1, 2, 7) for k in (1, 2))
    assert {r.n for r in found} == {4}  # the repeated vector counts once, the empty one is zero
    assert all(math.isfinite(r.whitened) for r in found) and found[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, "", 0)], [(1, [0.5, 0.5], "", 0), (2, [0.5, 0.5], "", 0)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect() == []


def test_a_flat_direction_has_no_component(spark):
    rows = [(k, [k / 7, k / 7, 0.25], "", 0) for k in range(20)]
    found = whitening.whitened(spark.createDataFrame(rows, KIND), Scratch(spark, "t")).collect()
    assert len(found) == 20 and {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)
