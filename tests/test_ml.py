import numpy as np
from pyspark.sql import functions as F

from sidelines.ml.features import stratified_folds
from sidelines.ml.knn import knn_regression, knn_state
from sidelines.ml.metrics import regression_metrics, t_cdf, t_quantile, univariate_table
from sidelines.ml.models import fit_lasso, fit_rff_svr
from sidelines.ml.recipe import recipe
from sidelines.ml.smoother import local_smooth
from sidelines.ml.stack import fit_stack, penalty_path


def test_folds_balanced_per_stratum(spark):
    df = spark.range(0, 1003).withColumn("s", (F.col("id") % 3).cast("string"))
    f = stratified_folds(df, "s", 10, "id")
    sizes = f.groupBy("s", "fold").count().collect()
    by_s = {}
    for r in sizes:
        by_s.setdefault(r["s"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 10 for v in by_s.values())
    assert {r["fold"] for r in sizes} == set(range(10))


def test_metrics_rsq_is_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 5.0), (4.0, 4.0)], "y double, p double")
    m = regression_metrics(df, "y", ["p"]).first()
    y, p = np.array([1, 2, 3, 4.0]), np.array([2, 2.5, 5, 4.0])
    assert abs(m["rmse"] - np.sqrt(np.mean((p - y) ** 2))) < 1e-12
    assert abs(m["mae"] - np.mean(np.abs(p - y))) < 1e-12
    assert abs(m["rsq"] - np.corrcoef(y, p)[0, 1] ** 2) < 1e-12


def test_t_distribution():
    assert abs(t_cdf(2.0, 10) - 0.9633062) < 1e-6
    assert abs(t_quantile(0.975, 30) - 2.0422725) < 1e-5


def test_lasso_recovers_planted_signal(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=500), rng.normal(size=500)
    y = 3 * x1 + 0.05 * rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    coef = list(fit_lasso(df, ["x1", "x2"], "y", 0.01).stages[-1].coefficients)
    assert abs(coef[0] - 3) < 0.1 and abs(coef[1]) < 0.05
    ut = {r["term"]: r for r in univariate_table(df, "y", ["x1", "x2"]).collect()}
    assert ut["x1"]["p_value"] < 1e-6 and ut["x2"]["p_value"] > 0.001


def test_rff_svr_beats_constant(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, size=400)
    y = np.sin(x) + 0.05 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = fit_rff_svr(df, ["x"], "y", n_components=40, gamma=0.5)
    e = m.transform(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert e < 0.5 * np.std(y)


def test_stack_weights_nonnegative(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=300)
    good, bad = y + 0.1 * rng.normal(size=300), -y + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 5) for i, (a, b, c) in enumerate(zip(y, good, bad))],
                               "y double, good double, bad double, fold int")
    st = fit_stack(df, ["good", "bad"], "y", penalty_path(-4, -1, 10))
    assert all(w >= 0 for w in st.weights) and st.weights[0] > 0.5 and st.weights[1] == 0


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(120, 8)).astype(np.float32)
    lab = rng.integers(0, 3, size=120)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(120)],
                               "id long, emb array<float>, label int")
    Xd = X.astype(np.float64)
    D = np.sqrt(((Xd[:, None, :] - Xd[None, :, :]) ** 2).sum(-1))
    for block_rows in (20_000, 30):          # one block, and several
        got = {r["id"]: r["pred"] for r in knn_regression(df, "id", "emb", "label", k=4, block_rows=block_rows).collect()}
        for i in range(120):
            order = sorted((D[i, j], j) for j in range(120) if j != i)[:4]
            assert abs(got[i] - np.mean([lab[j] for _, j in order])) < 1e-12


def test_local_smoother_on_a_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1.0) for x in range(0, 30) for _ in range(3)], "x double, y double")
    out = {r["grid_x"]: r["fit"] for r in local_smooth(df, "x", "y", [5.0, 10.0, 20.0], 4.0).collect()}
    assert all(abs(out[g] - (2 * g + 1)) < 1e-9 for g in out)


def test_recipe_filters(spark):
    df = spark.range(0, 200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2 + 1).cast("double").alias("b"),
                                    F.lit(1.0).alias("c"), (F.col("id") % 7).cast("double").alias("d"),
                                    ((F.col("id") % 7) + F.col("id") % 3).cast("double").alias("e"),
                                    (F.col("id") % 3).cast("double").alias("f"))
    rm = recipe(df, ["a", "b", "c", "d", "e", "f"], corr=0.99, lincomb=True, scale=True)
    assert rm.dropped["c"] == "zero_variance"
    assert "a" in rm.dropped or "b" in rm.dropped            # perfectly correlated pair
    assert rm.dropped.get("f") == "linear_combination"        # f = e - d


def test_knn_ties_go_to_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], i % 7) for i in range(400)], "id long, emb array<double>, label int")
    for block_rows in (4096, 64):
        got = {r["qid"]: r["nb_id"] for r in knn_state(df, "id", "emb", "label", k=5, block_rows=block_rows).collect()}
        assert all(got[i] == [j for j in range(6) if j != i][:5] for i in range(400))
