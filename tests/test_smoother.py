"""Loess by span and the penalised spline against direct computation."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sidelines.ml.smoother import bspline_basis, loess, penalised_spline


def direct(x, y, at, span, degree):
    n = len(x)
    d = np.abs(x - at)
    h = np.sort(d)[max(int(np.floor(n * span + 1e-5)), 1) - 1] if span < 1 else d.max() * span
    if h == 0:
        return y[d == 0].mean(), h
    k = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    use = k > 0
    degree = min(degree, len(set(x[use])) - 1)
    b = np.vander((x - at) / h, degree + 1, increasing=True)
    return np.linalg.lstsq(b[use] * np.sqrt(k[use])[:, None], y[use] * np.sqrt(k[use]), rcond=None)[0][0], h


def frame(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)


@pytest.mark.parametrize("span,degree", [(0.2, 2), (0.75, 2), (0.5, 1), (0.3, 0), (1.4, 2)])
def test_loess_equals_direct_fits(spark, span, degree):
    rng = np.random.default_rng(2)
    x = np.round(rng.gamma(2, 3, 250), 1)                    # ties, uneven spacing
    y = np.sin(x) + rng.normal(size=250) * 0.1
    grid = [0.0, 0.05, 1.0, 2.5, 7.77, float(x.max()), 60.0 if span > 1 else 12.0]
    got = {r["grid_x"]: r for r in loess(frame(spark, x, y), "x", "y", grid, span, degree).collect()}
    for g in grid:
        fit, h = direct(x, y, g, span, degree)
        assert got[g]["h"] == pytest.approx(h) and got[g]["fit"] == pytest.approx(fit, abs=1e-7)


def test_loess_few_values_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 6.0), (5.0, 1.0), (None, 9.0), (2.0, None)], "x double, y double")
    got = {r["grid_x"]: (r["fit"], r["h"]) for r in loess(df, "x", "y", [1.0, 3.0], 0.75).collect()}
    assert got[1.0] == (4.0, 0.0) and got[3.0][1] == 2.0
    assert [tuple(r) for r in loess(df.limit(0), "x", "y", [1.0]).collect()] == [(1.0, None, None)]
    with pytest.raises(ValueError):
        loess(df, "x", "y", [1.0], degree=3)


def test_basis_is_a_partition_of_one():
    x = np.linspace(-2, 7, 400)
    for degree in (1, 2, 3):
        b = bspline_basis(x, -2, 7, 9, degree)
        assert b.shape == (400, 9) and (b >= -1e-12).all() and np.allclose(b.sum(1), 1)
    assert np.allclose(bspline_basis(np.array([-2.0, 7.0]), -2, 7, 4, 1), [[1, 0, 0, 0], [0, 0, 0, 1]])


def test_spline_finds_a_planted_curve(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 3000)
    fit = penalised_spline(frame(spark, x, np.sin(x) * 3 + 100 + rng.normal(size=3000)), "x", "y", size=20)
    grid = np.linspace(0.3, 9.7, 50)
    assert np.abs(fit.values(grid) - np.sin(grid) * 3 - 100).max() < 0.35
    line = penalised_spline(frame(spark, x, 2 * x + 1 + rng.normal(size=3000) * 0.01), "x", "y")
    assert np.abs(line.values(grid) - 2 * grid - 1).max() < 0.01 and line.edf < 6


def test_spline_equals_least_squares_with_rows_of_the_penalty(spark):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(-1, 1, 200), rng.normal(size=200)
    fit = penalised_spline(frame(spark, x, y), "x", "y", [0.7], size=7)
    b = bspline_basis(x, x.min(), x.max(), 7)
    d = np.diff(np.eye(7), 2, axis=0) * np.sqrt(0.7)
    want = np.linalg.lstsq(np.vstack([b, d]), np.concatenate([y, np.zeros(5)]), rcond=None)[0]
    assert np.allclose(fit.coefficients, want, atol=1e-8)


def test_spline_odd_inputs(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 5.0), (None, 7.0)], "x double, y double")
    assert penalised_spline(df, "x", "y").values([0.0, 9.0]).tolist() == [3.0, 3.0]
    assert penalised_spline(df.limit(0), "x", "y") is None
    with pytest.raises(ValueError):
        penalised_spline(df, "x", "y", size=3)
