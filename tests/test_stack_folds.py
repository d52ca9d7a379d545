"""Models of many folds in the same scans equal one fit for each fold."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sidelines.ml.gramcv import fit_linear, linear_folds
from sidelines.ml.models import assembled, fit_gbt
from sidelines.ml.stack import FoldModels, oof_predictions
from sidelines.ml.svr import fit_svr, fit_svr_folds
from sidelines.ml.trees import forest_folds, gbt_folds, limits

COLS = [f"x{j}" for j in range(5)]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(900, 3)), rng.integers(0, 4, 900), rng.exponential(size=900)])
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 3] > 1) + 0.3 * rng.normal(size=900) + 40
    df = spark.createDataFrame([(i, i % 3, float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))], ["id", "fold", "y", *COLS])
    df.write.parquet(str(tmp_path_factory.mktemp("folds") / "t"), mode="overwrite")
    return df.cache(), x, y


def test_boosted_trees_are_mllibs(spark, rows):
    df, x, _ = rows
    got = gbt_folds(df, COLS, "y", ["id"], "fold", [1, None], trees=6, depth=3)
    for f, model in zip([1, None], got):
        train = df if f is None else df.where(F.col("fold") != f)
        want = fit_gbt(train, COLS, "y", trees=6, tree_depth=3).transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
        assert np.abs(model.of_rows(x) - want).max() < 1e-9


def test_one_tree_is_mllibs(spark, rows):
    from pyspark.ml.regression import DecisionTreeRegressor
    df, x, _ = rows
    got = forest_folds(df, COLS, "y", ["id"], "fold", [0, None], trees=1, depth=5, min_n=5, mtry=5)
    for f, model in zip([0, None], got):
        train = df if f is None else df.where(F.col("fold") != f)
        want = assembled(COLS, DecisionTreeRegressor(maxDepth=5, minInstancesPerNode=5), "y").fit(train).transform(df)
        assert np.abs(model.of_rows(x) - want.orderBy("id").toPandas()["prediction"].to_numpy()).max() < 1e-9


def test_forest_learns_and_does_not_depend_on_partitions(spark, rows):
    df, x, y = rows
    one, = forest_folds(df, COLS, "y", ["id"], "fold", [2], trees=8, min_n=5)
    two, = forest_folds(df.repartition(7), COLS, "y", ["id"], "fold", [2], trees=8, min_n=5)
    held = np.arange(900) % 3 == 2
    assert np.abs(one.of_rows(x) - two.of_rows(x)).max() < 1e-9
    assert ((one.of_rows(x) - y)[held] ** 2).mean() < 0.6 * y[held].var() and len(np.unique(one.feature[:, 0])) > 1


def test_limits_and_odd_rows(spark):
    assert limits(np.array([3.0, 1, 1, np.nan, 2])).tolist() == [1.5, 2.5] and len(limits(np.full(9, 2.0))) == 0
    assert len(limits(np.arange(10_000.0))) == 31
    df = spark.createDataFrame([(i, i % 2, None if i == 3 else float(i % 5 > 2), None if i % 4 == 0 else float(i % 5)) for i in range(40)],
                               "id long, fold int, y double, a double").withColumn("b", F.lit(1.0))
    for m in (*gbt_folds(df, ["a", "b"], "y", ["id"], "fold", [0, None], trees=3, depth=2), *forest_folds(df, ["a", "b"], "y", ["id"], "fold", [0, None], trees=3)):
        assert np.isfinite(m.of_rows(np.array([[0.0, 1.0], [np.nan, 1.0], [4.0, 2.0]]))).all()
    with pytest.raises(ValueError):
        gbt_folds(df.limit(0), ["a", "b"], "y", ["id"], "fold", [None])


def test_linear_and_svr_folds_equal_single_fits(spark, rows):
    df, x, _ = rows
    for f, m in zip([2, None], linear_folds(df, COLS, "y", "fold", [2, None], 0.01, 0.5)):
        want = fit_linear(df if f is None else df.where(F.col("fold") != f), COLS, "y", 0.01, 0.5)
        assert np.abs(m.coefficients - want.coefficients).max() < 1e-9 and abs(m.intercept - want.intercept) < 1e-9
    few = df.where("id < 60")                      # fewer rows than landmarks: the same landmarks, whatever the hash
    for f, m in zip([2, None], fit_svr_folds(few, COLS, "y", "fold", [2, None], cost=0.5, iterations=15)):
        want = fit_svr(few if f is None else few.where(F.col("fold") != f), COLS, "y", cost=0.5, iterations=15)
        assert np.abs(m.of_rows(x) - want.of_rows(x)).max() < 1e-4 and abs(m.inside - want.inside) < 1e-9


def test_svr_folds_leave_their_fold_out(spark, rows):
    df, _, _ = rows
    spoilt = df.withColumn("y", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("y"))).withColumn("x0", F.when(F.col("fold") == 1, -50.0).otherwise(F.col("x0")))
    a, = fit_svr_folds(df, COLS, "y", "fold", [1], landmarks=16, iterations=8)
    b, = fit_svr_folds(spoilt, COLS, "y", "fold", [1], landmarks=16, iterations=8)
    assert np.allclose(a.landmarks, b.landmarks) and np.allclose(a.weights, b.weights, atol=1e-6) and abs(a.y_mean - b.y_mean) < 1e-6


def test_rows_that_share_a_key_keep_their_own_prediction(spark, rows):
    df, x, _ = rows
    df = df.withColumn("key", F.expr("id div 2"))
    fits = {"gbt": FoldModels.fit(lambda d, c, out: gbt_folds(d, COLS, "y", ["id"], c, out, trees=2, depth=2), df, COLS, "fold", [0, 1, 2])}
    got = oof_predictions(df, "fold", fits, ["key", "id"], 3).orderBy("id").toPandas()
    want = np.array([fits["gbt"].models[i % 3].of_rows(x[i:i + 1])[0] for i in range(900)])
    assert got.columns.tolist() == ["key", "id", "fold", "gbt"] and np.abs(got["gbt"].to_numpy() - want).max() < 1e-12


def test_codes_of_columns_are_the_nodes_of_a_walk():
    from sidelines.ml.trees import _boosted, _codes, _walk
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (200, 4)).astype(np.uint16)
    feature, cut, value = rng.integers(0, 4, (7, 31)), rng.integers(-1, 50, (7, 31)), rng.normal(size=(7, 32))
    for levels in range(6):
        got = _codes(np.ascontiguousarray(x.T), feature[0], cut[0], levels)
        assert (got == _walk(x.ravel(), np.arange(200) * 4, feature[0], cut[0], levels)).all()
    want = sum(v[_walk(x.ravel(), np.arange(200) * 4, f, c, 5)] for f, c, v in zip(feature, cut, value))
    assert np.abs(_boosted(np.ascontiguousarray(x.T), feature, cut, value, 5) - want).max() < 1e-12
