"""Cross products, correlations and cross-validation from fold moments."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sidelines.ml.gram import moments, pairwise_correlations
from sidelines.ml.gramcv import cross_validate, fit_linear, solve

COLS = ["x1", "x2", "x3", "x4"]


def frame(spark, n=600, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 20, 0.1, 3] + offset
    x[:, 3] += 0.9 * x[:, 0]
    y = 2 * x[:, 0] - 0.05 * x[:, 1] + 4 * x[:, 2] + rng.normal(size=n)
    return x, y, spark.createDataFrame([(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y))],
                                       "x1 double, x2 double, x3 double, x4 double, y double, fold int").repartition(4)


def test_moments_by_group_and_shift(spark):
    x, y, df = frame(spark, offset=1e7)
    by = moments(df, [*COLS, "y"], "fold")
    z = np.column_stack([x, y])
    for f, m in by.items():
        part = z[np.arange(len(z)) % 5 == f]
        d = part - part.mean(0)
        assert m.n == len(part) and np.allclose(m.means, part.mean(0), rtol=1e-12)
        assert np.allclose(m.centred, d.T @ d, rtol=1e-6, atol=1e-6)
    whole = moments(df, COLS)[0]
    g, s = whole.raw
    assert np.allclose(g, x.T @ x) and np.allclose(s, x.sum(0))
    assert moments(df.limit(0), COLS) == {}


def test_correlations_of_three_hundred_columns_with_gaps(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 300))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.0
    df = spark.createDataFrame([tuple(None if np.isnan(t) else float(t) for t in r) for r in x], ", ".join(f"c{i} double" for i in range(300)))
    got = pairwise_correlations(df, df.columns)
    for i, j in [(0, 1), (5, 299), (7, 8), (120, 33)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = np.nan if 7 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got[i, j] == pytest.approx(want, abs=1e-10, nan_ok=True)
    assert np.isnan(pairwise_correlations(df.limit(0), ["c0", "c1"])[0, 1])


@pytest.mark.parametrize("penalty,mixture", [(0.0, 0.0), (0.3, 0.0), (0.05, 1.0), (0.2, 0.4), (50.0, 1.0)])
def test_fit_equals_mllib(spark, penalty, mixture):
    _, _, df = frame(spark)
    got = fit_linear(df, COLS, "y", penalty, mixture)
    v = VectorAssembler(inputCols=COLS, outputCol="f").transform(df)
    want = LinearRegression(featuresCol="f", labelCol="y", regParam=penalty, elasticNetParam=mixture, maxIter=2000, tol=1e-14).fit(v)
    assert np.allclose(got.coefficients, want.coefficients.toArray(), atol=1e-6)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-5)


def test_cross_validation_equals_refits(spark):
    x, y, df = frame(spark)
    grid = [(p, m) for p in (0.01, 0.1, 1.0) for m in (0.0, 0.5, 1.0)]
    best, res = cross_validate(df, COLS, "y", "fold", grid)
    assert len(res) == len(grid) * 5
    fold = np.arange(len(y)) % 5
    for config, penalty, mixture, f, rmse, rsq in res:
        fit = fit_linear(df.where(F.col("fold") != f), COLS, "y", penalty, mixture) if config in (1, 5) else None
        if fit is None:
            continue
        e = fit.intercept + x[fold == f] @ fit.coefficients - y[fold == f]
        assert rmse == pytest.approx(np.sqrt(np.mean(e ** 2)), abs=1e-6)
        assert rsq == pytest.approx(np.corrcoef(x[fold == f] @ fit.coefficients, y[fold == f])[0, 1] ** 2, abs=1e-6)
    mean = {i: np.mean([r[4] for r in res if r[0] == i]) for i in range(len(grid))}
    assert (best.penalty, best.mixture) == grid[min(mean, key=mean.get)]
    out = best.transform(df).select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert out < 1.1


def test_constant_and_missing_values(spark):
    _, _, df = frame(spark)
    odd = df.withColumn("x2", F.lit(4.0)).withColumn("x3", F.when(F.rand(3) > 0.2, F.col("x3")))
    fit = fit_linear(odd, COLS, "y", 0.1, 0.5)
    assert fit.coefficients[1] == 0 and np.isfinite(fit.coefficients).all()
    m = moments(odd.withColumn("y", F.lit(2.0)), [*COLS, "y"])[0]
    flat, _ = solve(m, 0.1, 0.5)
    assert not flat.coefficients.any() and flat.intercept == pytest.approx(2.0)
    with pytest.raises(ValueError):
        cross_validate(df.limit(0), COLS, "y", "fold", [(0.1, 0.5)])
