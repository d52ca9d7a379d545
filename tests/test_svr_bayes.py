"""Epsilon-insensitive machine on landmark features; search by expected improvement."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sidelines.ml.bayes import bayes_search, fold_errors, propose, results_frame
from sidelines.ml.gramcv import fit_linear
from sidelines.ml.svr import _Lbfgs, fit_svr, svr_folds


def planted(spark, n=800, noise=0.1):
    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 2, (n, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] ** 2 + 10 + noise * rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y double, fold int")


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 30.0, 400.0])
    o = _Lbfgs(3)
    for _ in range(80):
        x = o.ask()
        o.tell(float(0.5 * x @ a @ x - x.sum()), a @ x - 1)
    assert np.allclose(o.x, [1, 1 / 30, 1 / 400], atol=1e-6)


def test_beats_the_line_and_fills_the_tube(spark):
    df = planted(spark)
    train, test = df.where("fold > 0"), df.where("fold = 0")
    m = fit_svr(train, ["a", "b"], "y", cost=10.0, sigma=0.7)
    assert rmse(m.transform(test)) < 0.3 < 1.5 < rmse(fit_linear(train, ["a", "b"], "y").transform(test))
    wide = fit_svr(train, ["a", "b"], "y", cost=10.0, sigma=0.7, epsilon=0.5)
    assert 0.6 < m.inside <= wide.inside <= 1.0
    inside = m.transform(train).where(F.abs(F.col("prediction") - F.col("y")) <= m.epsilon * m.y_std).count() / train.count()
    assert inside == pytest.approx(m.inside, abs=0.05)


def test_outliers_pull_less_than_squares(spark):
    df = spark.range(400).select((F.col("id") / 100).alias("a"), F.when(F.col("id") % 40 == 0, 300.0).otherwise(F.col("id") / 50).alias("y"))
    m = fit_svr(df, ["a"], "y", cost=50.0, sigma=0.3, epsilon=0.005, delta=0.005)
    clean = df.where("y < 100")
    assert rmse(m.transform(clean)) < 0.5 * rmse(fit_linear(df, ["a"], "y").transform(clean))


def test_shared_scans_equal_single_fits(spark):
    df = planted(spark, 300)
    both = svr_folds(df, ["a", "b"], "y", [(1.0, 0.5), (20.0, 1.5)], "fold", landmarks=40)
    alone = svr_folds(df, ["a", "b"], "y", [(20.0, 1.5)], "fold", landmarks=40)
    assert [len(e) for e in both] == [5, 5] and np.allclose(both[1], alone[0], rtol=0.02)


def test_nulls_and_one_row(spark):
    df = planted(spark, 60).withColumn("a", F.when(F.col("fold") != 1, F.col("a"))).withColumn("y", F.when(F.col("fold") != 2, F.col("y")))
    out = fit_svr(df, ["a", "b"], "y").transform(df)
    assert out.where("prediction IS NULL OR isnan(prediction)").count() == 0
    one = fit_svr(df.where("y IS NOT NULL").limit(1), ["a", "b"], "y")
    assert one.transform(df.limit(1)).first()["prediction"] == pytest.approx(one.y_mean, abs=0.2)


SPACE = {"u": (0.0, 1.0, "lin"), "v": (1e-3, 1e3, "log"), "k": (1, 9, "int")}


def test_search_finds_the_minimum_better_than_chance():
    def evaluate(cs):
        return [[(c["u"] - 0.3) ** 2 + (np.log10(c["v"]) - 1) ** 2 / 4 + abs(c["k"] - 6) / 20 + s for s in (0.0, 0.01)] for c in cs]
    best, rec = bayes_search(SPACE, evaluate, 8, 20, 4, seed=3)
    assert len(rec) == 28 and [r["iteration"] for r in rec] == [0] * 8 + [i for i in range(1, 6) for _ in range(4)]
    first, last = min(r["mean"] for r in rec[:8]), min(r["mean"] for r in rec)
    assert last < 0.08 < first and {k: rec[int(np.argmin([r["mean"] for r in rec]))][k] for k in SPACE} == best
    assert all(isinstance(r["k"], int) and r["n"] == 2 for r in rec)
    new = propose(SPACE, [{k: r[k] for k in SPACE} for r in rec], [r["mean"] for r in rec], 5, 9)
    assert len({tuple(c.items()) for c in new}) == 5


def test_search_with_fits_and_result_table(spark):
    df = planted(spark, 200)
    space = {"penalty": (1e-3, 10.0, "log")}
    evaluate = fold_errors(lambda d, s: fit_linear(d, ["a", "b"], "y", s["penalty"], 1.0), df, "y", "fold")
    best, rec = bayes_search(space, evaluate, 3, 2, 2)
    t = results_frame(spark, space, rec)
    assert t.count() == 5 and t.agg(F.min("mean")).first()[0] == min(r["mean"] for r in rec) and best["penalty"] > 0


def test_loss_and_gradient_come_from_the_kernel_values():
    from sidelines.ml.svr import _kernel, _loss_and_slope, _whitened
    rng = np.random.default_rng(3)
    x, at, y, fold = rng.normal(size=(50, 4)), rng.normal(size=(6, 4)), rng.normal(size=50), np.arange(50) % 5
    assert np.allclose(_kernel(x, at, 0.3), np.exp(-0.3 * ((x[:, None] - at[None]) ** 2).sum(2)))
    k, to = _kernel(x, at, 0.3), _whitened(at, 0.3)
    machines = [(rng.normal(size=to.shape[1] + 1), out) for out in (None, 2)]
    got = _loss_and_slope(k, y, fold, to, machines, 0.1, 0.02)
    for (theta, out), found in zip(machines, got):
        use = np.ones(50, bool) if out is None else fold != out
        z = (k @ to)[use]
        r = z @ theta[:-1] + theta[-1] - y[use]
        over = np.abs(r) - 0.1
        loss = np.where(over <= 0, 0.0, np.where(over < 0.02, over * over / 0.04, over - 0.01))
        slope = np.clip(over / 0.02, 0, 1) * np.sign(r)
        assert np.allclose(found, np.concatenate([[loss.sum(), use.sum(), (over <= 0).sum()], slope @ z, [slope.sum()]]))
