"""Feature, model and evaluation queries."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from statistics import NormalDist

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sidelines.ml.bayes import bayes_search, results_frame
from sidelines.ml.features import FEATURE_SETS, stratified_folds
from sidelines.ml.gram import column_means
from sidelines.ml.gramcv import RESULT, cross_validate, fit_linear, linear_folds
from sidelines.ml.importance import coefficient_importance, permutation_importance, permute_column
from sidelines.ml.knn import first_neighbours, knn_regression, knn_state, weighted_mean
from sidelines.ml.metrics import compare_models, fold_summary, regression_metrics, univariate_table
from sidelines.ml.models import (fit_bagged_mlp, fit_enet, fit_forest, fit_gbt, fit_lasso, fit_rff_svr)
from sidelines.ml.recipe import corr_matrix, gram_matrix, recipe, spline_basis, zero_variance
from sidelines.ml.smoother import local_smooth, loess, penalised_spline
from sidelines.ml.stack import FoldModels, StackModel, fit_stack, oof_predictions, penalty_path
from sidelines.ml.store import FittedStack, load_stack, save_stack
from sidelines.ml.svr import fit_svr, fit_svr_folds, svr_folds
from sidelines.ml.trees import forest_folds, gbt_folds
from sidelines.ml.tune import latin_hypercube
from sidelines.operators.aggregates import scalar
from sidelines.operators.joins import enrich
from sidelines.operators.reshape import append
from sidelines.operators.windows import lagged_cum
from sidelines.plans.catalog import finish, register
from sidelines.session import checkpoint_dir, cut_lineage
from sidelines.plans.kicker import KICKER_KEYS, kicker_games
from sidelines.plans.q_plays import BASE, GAMES, MIN_ATTEMPTS, MIN_GAMES, plays, with_
from sidelines.sources.io import table

TEST_FROM = "2024-01-22"  # last full week of events is the test season
LABEL = "y"
KEY = ["season", "game_id", "posteam"]


def model_frame(spark, sf):
    """Modelling rows: the modelling table (one row per kicker-game, first
    season dropped after the lags, last-day exclusion), NULL features imputed
    by the training rows' mean, label = kicker points."""
    from sidelines.plans.final import final_data
    from sidelines.plans.q_team import FIRST_SEASON, LAST_DAYS
    fd = final_data(plays(spark, sf), MIN_GAMES, MIN_ATTEMPTS, first_season=FIRST_SEASON,
                    exclude_weeks=[(w, c()) for w, _, c in LAST_DAYS], parity=True)
    fd = fd.withColumn("season_num", F.expr(f"datediff(season, DATE '{FIRST_SEASON}') div 7"))
    feats = sorted({c for v in FEATURE_SETS.values() for c in v})
    frame = fd.withColumns({c: F.col(c).cast("double") for c in feats})
    frame = frame.withColumn(LABEL, F.col("total_points").cast("double")) \
                 .withColumn("split", F.when(F.col("season") < F.lit(TEST_FROM).cast("date"), "train").otherwise("test"))
    frame = cut_lineage(frame.select(*KEY, *KICKER_KEYS, *feats, LABEL, "fpts_site", "split"))
    # NULL features -> mean over the training rows (0 where a column has none): as many numbers as features.
    # Filled in on reading: the fits that read their rows many times keep a copy of their own
    means = column_means(frame.where("split = 'train'"), feats)
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(means[c] or 0.0)) for c in feats})


def split(frame):
    return frame.where(F.col("split") == "train"), frame.where(F.col("split") == "test")


# ---------------------------------------------------------------- SQL-checked

@register("stratified_folds", """
SELECT o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 10 AS BIGINT) AS fold
FROM orders""")
def q_stratified_folds(spark, sf):
    """M2: 10 folds stratified on status (3 levels, so levels are the strata)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return finish(stratified_folds(o, "o_orderstatus", 10, "o_orderkey"))


RECIPE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("recipe_filters", """
SELECT 'l_quantity' AS column, round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max,
       coalesce(min(l_quantity) = max(l_quantity), true) AS zero_var FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(min(l_extendedprice), 6), round(max(l_extendedprice), 6),
       coalesce(min(l_extendedprice) = max(l_extendedprice), true) FROM lineitem
UNION ALL SELECT 'l_discount', round(min(l_discount), 6), round(max(l_discount), 6),
       coalesce(min(l_discount) = max(l_discount), true) FROM lineitem
UNION ALL SELECT 'l_tax', round(min(l_tax), 6), round(max(l_tax), 6), coalesce(min(l_tax) = max(l_tax), true) FROM lineitem
UNION ALL SELECT 'l_linenumber', round(min(l_linenumber), 6), round(max(l_linenumber), 6),
       coalesce(min(l_linenumber) = max(l_linenumber), true) FROM lineitem
UNION ALL SELECT 'const_one', 1.0, 1.0, true FROM lineitem LIMIT 6""")
def q_recipe_filters(spark, sf):
    """M3: zero-variance filter statistics in one pass (a constant column
    included to show the filter firing)."""
    li = table(spark, sf, "lineitem").withColumn("const_one", F.lit(1.0))
    return finish(zero_variance(li, RECIPE_COLS + ["const_one"]))


@register("standardize", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6)
    AS l_quantity,
  round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
        / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS l_extendedprice
FROM lineitem""")
def q_standardize(spark, sf):
    """M7: centre and scale (sample standard deviation)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rm = recipe(li, ["l_quantity", "l_extendedprice"], zv=False, corr=None, lincomb=False, scale=True)
    return finish(rm.transform(li))


@register("univariate_regression", """
WITH l AS (UNPIVOT (SELECT l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem)
           ON l_quantity, l_discount, l_tax INTO NAME term VALUE x),
f AS (SELECT term, regr_slope(y, x) AS beta, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx,
             regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_count(y, x) AS n FROM l GROUP BY term)
SELECT term, round(beta, 6) AS beta, round(intercept, 6) AS intercept,
       round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS se,
       round(beta / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS t_stat, CAST(n AS BIGINT) AS n FROM f""")
def q_univariate_regression(spark, sf):
    """M9: one-predictor Gaussian fits (beta, intercept, se, t) in one groupBy."""
    li = table(spark, sf, "lineitem")
    return finish(univariate_table(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], inference=False))


@register("local_smoother", """
WITH pts AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS sy FROM lineitem
             WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS DOUBLE) AS grid_x FROM range(1, 51)),
j AS (SELECT grid_x, x, n, sy, x - grid_x AS dx, pow(1 - pow(abs(x - grid_x) / 5.0, 3), 3) * n AS w
      FROM g JOIN pts ON abs(x - grid_x) < 5.0),
s AS (SELECT grid_x, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * sy / n) AS t0,
             sum(w * dx * sy / n) AS t1, count(*) AS n_x FROM j GROUP BY grid_x)
SELECT grid_x, round(CASE WHEN n_x >= 2 AND s0 * s2 - s1 * s1 <> 0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, 6)
       AS fit, round(s0, 6) AS n_eff FROM s""")
def q_local_smoother(spark, sf):
    """Tricube local-linear curve of price on quantity at 50 grid points."""
    li = table(spark, sf, "lineitem")
    return finish(local_smooth(li, "l_quantity", "l_extendedprice", list(range(1, 51)), 5.0))


LOESS_GRID = [2000.0 + 4500.0 * i for i in range(20)]
_CRAMER = """s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)"""


@register("loess_span", f"""
WITH g AS (SELECT unnest(CAST({LOESS_GRID} AS DOUBLE[])) AS grid_x),
d AS (SELECT grid_x, l_extendedprice - grid_x AS dx, l_quantity AS y, row_number() OVER (PARTITION BY grid_x ORDER BY abs(l_extendedprice - grid_x)) AS rk,
             count(*) OVER (PARTITION BY grid_x) AS n FROM lineitem, g WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
h AS (SELECT grid_x, max(abs(dx)) AS h FROM d WHERE rk <= floor(n * 0.3 + 1e-5) GROUP BY grid_x),
w AS (SELECT grid_x, h, y, dx / h AS u, pow(1 - pow(abs(dx) / h, 3), 3) AS k FROM d JOIN h USING (grid_x) WHERE abs(dx) < h),
s AS (SELECT grid_x, h, sum(k) AS s0, sum(k * u) AS s1, sum(k * u * u) AS s2, sum(k * pow(u, 3)) AS s3, sum(k * pow(u, 4)) AS s4,
             sum(k * y) AS t0, sum(k * u * y) AS t1, sum(k * u * u * y) AS t2 FROM w GROUP BY grid_x, h)
SELECT grid_x, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / ({_CRAMER}), 6) AS fit, round(h, 6) AS h FROM s""")
def q_loess_span(spark, sf):
    """Local quadratic curve of quantity on price, bandwidth from the nearest three tenths of the rows."""
    return finish(loess(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", LOESS_GRID, 0.3))


_HAT = {0: "greatest(1 - (x - lo) / s, 0)", 1: "greatest(1 - abs(x - lo - s) / s, 0)", 2: "greatest((x - lo - s) / s, 0)"}


@register("penalised_spline", f"""
WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 2 AS s FROM lineitem),
r AS (SELECT l_quantity AS y, lo, s, l_extendedprice AS x FROM lineitem, e),
b AS (SELECT y, lo, s, {_HAT[0]} AS b0, {_HAT[1]} AS b1, {_HAT[2]} AS b2 FROM r),
m AS (SELECT any_value(lo) AS lo, any_value(s) AS s, sum(b0 * b0) + 2000 AS s00, sum(b0 * b1) - 4000 AS s01, sum(b0 * b2) + 2000 AS s02, sum(b1 * b1) + 8000 AS s11,
             sum(b1 * b2) - 4000 AS s12, sum(b2 * b2) + 2000 AS s22, sum(b0 * y) AS t0, sum(b1 * y) AS t1, sum(b2 * y) AS t2 FROM b),
c AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02) AS det FROM m),
f AS (SELECT lo, s, (t0 * (s11 * s22 - s12 * s12) - s01 * (t1 * s22 - s12 * t2) + s02 * (t1 * s12 - s11 * t2)) / det AS c0,
             (s00 * (t1 * s22 - s12 * t2) - t0 * (s01 * s22 - s12 * s02) + s02 * (s01 * t2 - t1 * s02)) / det AS c1,
             (s00 * (s11 * t2 - t1 * s12) - s01 * (s01 * t2 - t1 * s02) + t0 * (s01 * s12 - s11 * s02)) / det AS c2 FROM c),
g AS (SELECT unnest(CAST({LOESS_GRID} AS DOUBLE[])) AS x)
SELECT x AS grid_x, round(c0 * {_HAT[0]} + c1 * {_HAT[1]} + c2 * {_HAT[2]}, 6) AS fit FROM g, f""")
def q_penalised_spline(spark, sf):
    """Three linear B-splines with a fixed penalty on their second difference, from one scan."""
    fit = penalised_spline(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", [2000.0], size=3, degree=1)
    return finish(fit.curve(spark, LOESS_GRID))


@register("gam_curve")
def q_gam_curve(spark, sf):
    """Ten cubic B-splines, smoothing by generalised cross-validation."""
    fit = penalised_spline(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return finish(fit.curve(spark, LOESS_GRID))


MODEL_SQL = with_(*BASE, GAMES, f"""
fr AS (
  SELECT season, game_id, posteam, CAST(total_points AS DOUBLE) AS y,
    coalesce(avg(total_points) OVER (PARTITION BY season, posteam, kicker_name, kicker_id ORDER BY game_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT avg(total_points) FROM games))
      AS szn_kkr_mean_pts,
    (SELECT avg(total_points) FROM games) AS overall_mean,
    CASE WHEN season < DATE '{TEST_FROM}' THEN 'train' ELSE 'test' END AS split
  FROM games)""")


@register("metrics_table", MODEL_SQL + """
SELECT split, model, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(CASE WHEN isnan(rsq) THEN NULL ELSE rsq END, 6) AS rsq FROM (
  SELECT split, 'szn_kkr_mean_pts' AS model, sqrt(avg((szn_kkr_mean_pts - y) ** 2)) AS rmse,
         avg(abs(szn_kkr_mean_pts - y)) AS mae, corr(szn_kkr_mean_pts, y) ** 2 AS rsq FROM fr GROUP BY split
  UNION ALL
  SELECT split, 'overall_mean', sqrt(avg((overall_mean - y) ** 2)), avg(abs(overall_mean - y)),
         corr(overall_mean, y) ** 2 FROM fr GROUP BY split)""")
def q_metrics_table(spark, sf):
    """M8 + M23: rmse / mae / squared correlation of the baseline predictors
    (season-to-date mean with overall fallback; the overall mean) by split."""
    g = kicker_games(plays(spark, sf))
    overall = scalar(g.agg(F.avg("total_points")))
    fr = g.select("season", "game_id", "posteam", F.col("total_points").cast("double").alias("y"),
                  F.coalesce(lagged_cum("total_points", "mean", ["season", "posteam", *KICKER_KEYS], ["game_id"]),
                             overall).alias("szn_kkr_mean_pts"),
                  overall.alias("overall_mean"),
                  F.when(F.col("season") < F.lit(TEST_FROM).cast("date"), "train").otherwise("test").alias("split"))
    m = regression_metrics(fr, "y", ["szn_kkr_mean_pts", "overall_mean"], keys=["split"])
    return finish(m.select("split", "model", "rmse", "mae", "rsq"))


def _baseline_sql():
    from sidelines.plans.q_team import _final_sql
    head, body = _final_sql().rsplit("\nSELECT fd1.season, fd1.game_id,", 1)
    fr = f"""{head}
, fdx AS (SELECT fd1.season, fd1.game_id,{body}),
fr AS (SELECT *, CASE WHEN season < DATE '{TEST_FROM}' THEN 'train' ELSE 'test' END AS split FROM fdx)"""
    return fr + "\n" + " UNION ALL ".join(f"""
SELECT split, '{m}' AS model, round(sqrt(avg(({m} - total_points) ** 2)), 6) AS rmse, round(avg(abs({m} - total_points)), 6) AS mae,
       round(CASE WHEN isnan(corr({m}, total_points)) THEN NULL ELSE corr({m}, total_points) ** 2 END, 6) AS rsq FROM fr GROUP BY split""" for m in BASELINES)


BASELINES = ["szn_kkr_mean_pts", "szn_def_kkr_mean_pts", "fpts_site"]


@register("baseline_predictors", _baseline_sql())
def q_baseline_predictors(spark, sf):
    """Errors of the kicker's mean so far, of what the opponent has
    allowed kickers so far, and of a published projection, on the modelling table."""
    from sidelines.plans.final import final_data
    from sidelines.plans.q_team import FIRST_SEASON, LAST_DAYS
    fd = final_data(plays(spark, sf), MIN_GAMES, MIN_ATTEMPTS, first_season=FIRST_SEASON,
                    exclude_weeks=[(w, c()) for w, _, c in LAST_DAYS], parity=True)
    fr = fd.select("total_points", *BASELINES, F.when(F.col("season") < F.lit(TEST_FROM).cast("date"), "train").otherwise("test").alias("split"))
    # both engines average means given to 6 places
    fr = fr.withColumns({m: F.round(F.col(m) * 1e6) / 1e6 for m in BASELINES})
    return finish(regression_metrics(fr, "total_points", BASELINES, keys=["split"]))


@register("model_comparison", MODEL_SQL + """
SELECT model, round(max(rmse) FILTER (WHERE split = 'train'), 6) AS rmse_train,
       round(max(rmse) FILTER (WHERE split = 'test'), 6) AS rmse_test,
       CASE model WHEN 'szn_kkr_mean_pts' THEN 'Season-to-date mean' ELSE 'Overall mean' END AS label
FROM (SELECT split, 'szn_kkr_mean_pts' AS model, sqrt(avg((szn_kkr_mean_pts - y) ** 2)) AS rmse FROM fr GROUP BY split
      UNION ALL SELECT split, 'overall_mean', sqrt(avg((overall_mean - y) ** 2)) FROM fr GROUP BY split)
GROUP BY model""")
def q_model_comparison(spark, sf):
    """Train and test RMSE side by side with display labels."""
    m = q_metrics_table(spark, sf)
    tr, te = m.where(F.col("split") == "train").drop("split"), m.where(F.col("split") == "test").drop("split")
    out = compare_models(tr, te, "rmse", {"szn_kkr_mean_pts": "Season-to-date mean", "overall_mean": "Overall mean"})
    return finish(out.select("model", "rmse_train", "rmse_test", "label"))


@register("knn_regression", """
WITH d AS (SELECT a.vec_id, b.vec_id AS nid, b.label AS nlabel,
                  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nid) AS rn FROM d),
p AS (SELECT vec_id, avg(nlabel) AS pred, count(*) AS n_neighbors FROM r WHERE rn <= 5 GROUP BY vec_id)
SELECT e.vec_id, CAST(e.label AS BIGINT) AS label, round(p.pred, 6) AS pred, p.n_neighbors
FROM embeddings e LEFT JOIN p ON e.vec_id = p.vec_id""")
def q_knn_regression(spark, sf):
    """Exact leave-one-out 5-NN regression of the label on the embedding
    (pivot cells and shells, pruned by the triangle inequality; the oracle is brute force)."""
    e = table(spark, sf, "embeddings")
    return finish(knn_regression(e, "vec_id", "embedding", "label", k=5))


@register("correlation_matrix", """
WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, CASE WHEN l_linenumber < 4 THEN l_tax END AS d,
                  CAST(l_linenumber AS DOUBLE) AS e, 1.0 AS f FROM lineitem)
""" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END, 6) AS r FROM l"
                         for i, x in enumerate("abcdef") for y in "abcdef"[i + 1:]))
def q_correlation_matrix(spark, sf):
    """M4: pairwise correlations (rows that have both values) from one scan of matrix products; a constant column has none."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"),
        F.when(F.col("l_linenumber") < 4, F.col("l_tax")).alias("d"), F.col("l_linenumber").alias("e"), F.lit(1.0).alias("f"))
    r = corr_matrix(li, list("abcdef"))
    rows = [("abcdef"[i], "abcdef"[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(6) for j in range(i + 1, 6)]
    return finish(spark.createDataFrame(rows, "x string, y string, r double"))


RIDGE_PENALTIES = [0.0, 500.0, 20000.0]


@register("ridge_cv", f"""
WITH l AS (SELECT CAST(l_orderkey % 10 AS BIGINT) AS fold, l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem),
p AS (SELECT unnest(CAST({RIDGE_PENALTIES} AS DOUBLE[])) AS penalty),
t AS (SELECT f.fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
             stddev_pop(y) AS sy, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
      FROM (SELECT DISTINCT fold FROM l) f JOIN l ON l.fold <> f.fold GROUP BY f.fold),
a AS (SELECT *, 1 + penalty / sy AS d, c12 / (s1 * s2) AS r, c1y / (s1 * sy) AS g1, c2y / (s2 * sy) AS g2 FROM t, p),
b AS (SELECT *, (d * g1 - r * g2) / (d * d - r * r) * sy / s1 AS b1, (d * g2 - r * g1) / (d * d - r * r) * sy / s2 AS b2 FROM a)
SELECT b.penalty, CAST(b.fold AS BIGINT) AS fold, round(sqrt(avg(pow(y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)), 2))), 4) AS rmse,
       round(pow(corr(b1 * x1 + b2 * x2, y), 2), 6) AS rsq
FROM b JOIN l ON l.fold = b.fold GROUP BY b.penalty, b.fold""")
def q_ridge_cv(spark, sf):
    """M10 + M13: ridge over 3 penalties and 10 folds, every fit and every
    fold's error from the folds' cross products of one scan."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("fold"), "l_quantity", "l_discount", "l_extendedprice")
    _, res = cross_validate(li, ["l_quantity", "l_discount"], "l_extendedprice", "fold", [(x, 0.0) for x in RIDGE_PENALTIES])
    out = spark.createDataFrame(res, RESULT).select("penalty", "fold", "rmse", "rsq")
    return finish(out.withColumn("rmse", F.round(F.col("rmse") * 1e4) / 1e4))


@register("permuted_column", """
WITH k AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS here, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS there FROM orders)
SELECT a.o_orderkey, a.o_custkey, round(b.o_totalprice, 6) AS o_totalprice FROM k a JOIN k b ON a.here = b.there""")
def q_permuted_column(spark, sf):
    """One column exactly permuted over all rows by two row numberings."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return finish(permute_column(o, "o_totalprice", ["o_orderkey"], 42))


@register("saved_model_scores", """
WITH t AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2,
             stddev_pop(l_extendedprice) AS sy, corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS g1,
             corr(l_discount, l_extendedprice) AS g2 FROM lineitem),
a AS (SELECT *, 1 + 500.0 / sy AS d FROM t),
b AS (SELECT *, (d * g1 - r * g2) / (d * d - r * r) * sy / s1 AS b1, (d * g2 - r * g1) / (d * d - r * r) * sy / s2 AS b2 FROM a)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(my + b1 * (l_quantity - m1) + b2 * (l_discount - m2), 4) AS prediction FROM lineitem, b""")
def q_saved_model_scores(spark, sf):
    """S2 + M22: a ridge is fitted, written to a store, read back and scores all rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    save_stack(spark, path, FittedStack(None, {"ridge": fit_linear(li, ["l_quantity", "l_discount"], "l_extendedprice", 500.0)}, None))
    out = load_stack(spark, path).transform(li).select("l_orderkey", "l_linenumber", "l_quantity", "prediction")
    return finish(out.withColumn("prediction", F.round(F.col("prediction") * 1e4) / 1e4))


KNN_GRID = [(1, 3, "triangular"), (2, 5, "epanechnikov"), (3, 4, "inv"), (2, 7, "gaussian"), (1, 5, "rank"), (2, 4, "cos")]
_KNN_SHAPE = {"triangular": "1 - w", "epanechnikov": "0.75 * (1 - w * w)", "inv": "1 / w", "rank": "6 - rn", "cos": "cos(w * pi() / 2)",
              "gaussian": f"exp(-0.5 * pow(w * {abs(NormalDist().inv_cdf(1 / 16))}, 2))"}


def _knn_sql(power, k, kernel):
    return f"""
SELECT vec_id, {power} AS power, {k} AS k, '{kernel}' AS kernel, sum(nlabel * x) / sum(x) AS pred, count(*) AS n_neighbors
FROM (SELECT vec_id, nlabel, {_KNN_SHAPE[kernel]} AS x
      FROM (SELECT *, greatest(least(dist / greatest(max(dist) OVER (PARTITION BY vec_id), 1e-6), 1 - 1e-6), 1e-6) AS w
            FROM r WHERE power = {power} AND rn <= {k + 1}) WHERE rn <= {k}) GROUP BY vec_id"""


@register("knn_kernels", """
WITH d AS (SELECT a.vec_id, b.vec_id AS nid, b.label AS nlabel,
                  [abs(CAST(x AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) for x, i in a.embedding] AS gap
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
p AS (SELECT vec_id, nid, nlabel, 1 AS power, list_sum(gap) AS dist FROM d
      UNION ALL SELECT vec_id, nid, nlabel, 2, sqrt(list_sum([g * g for g in gap])) FROM d
      UNION ALL SELECT vec_id, nid, nlabel, 3, pow(list_sum([g * g * g for g in gap]), 1.0 / 3) FROM d),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY power, vec_id ORDER BY dist, nid) AS rn FROM p) WHERE rn <= 8)
SELECT vec_id, CAST(power AS BIGINT) AS power, CAST(k AS BIGINT) AS k, kernel, round(pred, 6) AS pred, n_neighbors FROM ("""
          + " UNION ALL ".join(_knn_sql(*g) for g in KNN_GRID) + ")")
def q_knn_kernels(spark, sf):
    """The tuned settings (neighbours, weight function, distance power);
    one exact search for each power serves all its kernels."""
    e = table(spark, sf, "embeddings")
    parts = []
    for power in sorted({g[0] for g in KNN_GRID}):
        most = max(k for p, k, _ in KNN_GRID if p == power)
        st = cut_lineage(knn_state(e, "vec_id", "embedding", "label", most, power))
        for _, k, kernel in (g for g in KNN_GRID if g[0] == power):
            one = first_neighbours(st, k)
            parts.append(one.select(F.col("qid").alias("vec_id"), F.lit(power).alias("power"), F.lit(k).alias("k"), F.lit(kernel).alias("kernel"),
                                    weighted_mean(one, kernel, k).alias("pred"), F.size("nb_l").alias("n_neighbors")))
    return finish(append(*parts))


# ---------------------------------------------------------------- rows-only (model fits)

FEATS = FEATURE_SETS["season_to_date"]


def _test_metrics(model, test, name):
    return regression_metrics(model.transform(test).withColumnRenamed("prediction", name), LABEL, [name])


@register("gbt")
def q_gbt(spark, sf):
    """M11 (+M22, M8): boosted trees fitted on the training seasons, scored on the test season."""
    tr, te = split(model_frame(spark, sf))
    m = fit_gbt(tr, FEATS, LABEL, trees=50, tree_depth=3, min_n=5, learn_rate=0.1)
    return finish(_test_metrics(m, te, "gbt"))


@register("elastic_net")
def q_elastic_net(spark, sf):
    """Elastic net, mixture 0.5."""
    tr, te = split(model_frame(spark, sf))
    return finish(_test_metrics(fit_enet(tr, FEATS, LABEL, 0.01, 0.5), te, "elastic_net"))


@register("lasso")
def q_lasso(spark, sf):
    """M13 + M21: the source's "ridge" (mixture 1 = lasso) and its signed
    coefficient importance."""
    tr, _ = split(model_frame(spark, sf))
    m = fit_lasso(tr, FEATS, LABEL, 0.01)
    return finish(coefficient_importance(spark, list(m.stages[-1].coefficients), FEATS))


@register("forest")
def q_forest(spark, sf):
    """Random forest."""
    tr, te = split(model_frame(spark, sf))
    return finish(_test_metrics(fit_forest(tr, FEATS, LABEL, trees=50, min_n=5), te, "forest"))


@register("rff_svr")
def q_rff_svr(spark, sf):
    """RBF support-vector regression re-aimed as random Fourier
    features + Huber loss."""
    tr, te = split(model_frame(spark, sf))
    return finish(_test_metrics(fit_rff_svr(tr, FEATS, LABEL, n_components=32), te, "rff_svr"))


@register("bagged_mlp")
def q_bagged_mlp(spark, sf):
    """Bagged MLP (Poisson bootstrap weights, distributed full-batch Adam)."""
    tr, te = split(model_frame(spark, sf))
    m = fit_bagged_mlp(tr, FEATS, LABEL, hidden=6, bags=10, epochs=25, key=KEY)
    return finish(regression_metrics(m.transform(te, "bagged_mlp"), LABEL, ["bagged_mlp"]))


@register("svr")
def q_svr(spark, sf):
    """Epsilon-insensitive RBF regression on landmark features; test errors and the share of rows inside the tube."""
    tr, te = split(model_frame(spark, sf))
    m = fit_svr(tr, FEATS, LABEL, cost=1.0, iterations=40)
    return finish(_test_metrics(m, te, "svr").withColumn("inside", F.lit(m.inside)))


#: Member families of the stack (M18): name -> models without each of some folds, learnt in the same scans.
MEMBERS = {
    "enet": lambda d, fold, out: linear_folds(d, FEATS, LABEL, fold, out, 0.01, 0.5),
    "lasso": lambda d, fold, out: linear_folds(d, FEATS, LABEL, fold, out, 0.05, 1.0),
    "svr": lambda d, fold, out: fit_svr_folds(d, FEATS, LABEL, fold, out, cost=0.5, iterations=20),
    "forest": lambda d, fold, out: forest_folds(d, FEATS, LABEL, KEY, fold, out, trees=30, min_n=5),
    "gbt": lambda d, fold, out: gbt_folds(d, FEATS, LABEL, KEY, fold, out, trees=20, depth=3),
}


@register("stack")
def q_stack(spark, sf):
    """M18 + M19 + X19: out-of-fold predictions of five member families over
    ten folds blended by a non-negative lasso over a 20-penalty path; member
    and blend test RMSE."""
    tr, te = split(model_frame(spark, sf))
    tr = cut_lineage(stratified_folds(tr, "season", 10, KEY))
    left_out = [*range(10), None]                  # None: the refit on all rows
    with ThreadPoolExecutor(len(MEMBERS)) as pool:
        fits = dict(zip(MEMBERS, pool.map(lambda fit: FoldModels.fit(fit, tr, FEATS, "fold", left_out), MEMBERS.values())))
    oof = cut_lineage(oof_predictions(tr, "fold", fits, [*KEY, LABEL], 10))
    st = fit_stack(oof, list(MEMBERS), LABEL, penalty_path(-3, -0.5, 20))
    scored = te.select(*KEY, LABEL, *FEATS)
    for n, fit in fits.items():
        scored = fit.transform(scored, n)
    blended = st.transform(scored, "stack")
    return finish(regression_metrics(blended, LABEL, [*MEMBERS, "stack"]))


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Forest permutation importance (exact permutation, re-score)."""
    tr, _ = split(model_frame(spark, sf))
    m = fit_forest(tr, FEATS, LABEL, trees=30, min_n=5)
    return finish(permutation_importance(m.transform, tr, FEATS, LABEL, KEY, seed=42))


def _linear_search(spark, sf, space, mixture=None):
    tr, _ = split(model_frame(spark, sf))
    tr = stratified_folds(tr, "season", 10, KEY)
    grid = [(c["penalty"], c.get("mixture", mixture)) for c in latin_hypercube(space, 15, 42)]
    kept = recipe(tr, FEATS, corr=0.9, lincomb=True).columns                  # M3-M5
    _, res = cross_validate(tr, kept, LABEL, "fold", grid)
    by = fold_summary(spark.createDataFrame(res, RESULT), ["config", "penalty", "mixture"])
    return finish(by)


@register("tuning")
def q_tuning(spark, sf):
    """M10 + M12 + M26: Latin-hypercube search of the elastic net, 15 settings
    over 10 stratified folds from one scan; mean and standard error per setting."""
    return _linear_search(spark, sf, {"penalty": (1e-4, 1.0, "log"), "mixture": (0.05, 1.0, "lin")})


@register("tuning_lasso")
def q_tuning_lasso(spark, sf):
    """M10 + M13 + M26: 15 penalties of the model the source calls ridge (mixture 1) over 10 folds."""
    return _linear_search(spark, sf, {"penalty": (1e-4, 1.0, "log")}, 1.0)


@register("tuning_bayes")
def q_tuning_bayes(spark, sf):
    """M10 + M15 + M26: cost and sigma of the RBF machine, 10 first settings and
    20 proposed by expected improvement, over 10 folds; a batch's machines learn in shared scans."""
    tr, _ = split(model_frame(spark, sf))
    tr = cut_lineage(stratified_folds(tr, "season", 10, KEY))
    space = {"cost": (2.0 ** -10, 2.0 ** 5, "log"), "sigma": (1e-4, 1.0, "log")}

    def evaluate(settings):
        return svr_folds(tr, FEATS, LABEL, [(c["cost"], c["sigma"]) for c in settings], "fold", landmarks=32, iterations=15)

    _, records = bayes_search(space, evaluate, initial=10, iterations=20, batch=10)
    return finish(results_frame(spark, space, records))


@register("score_with_model")
def q_score_with_model(spark, sf):
    """M1 + M22: every named feature set fitted (lasso) and scored on the test season."""
    tr, te = split(model_frame(spark, sf))
    parts = []
    for name, cols in FEATURE_SETS.items():
        parts.append(_test_metrics(fit_lasso(tr, cols, LABEL, 0.01), te, name))
    return finish(append(*parts))


_D = "(greatest(l_discount - k[{0}], 0) ** 3 - greatest(l_discount - k[5], 0) ** 3) / (k[5] - k[{0}])"


@register("spline_basis", """
WITH q AS (SELECT quantile_cont(CAST(l_discount AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS k FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_discount, 6) AS l_discount, round(l_discount, 6) AS l_discount_ns1,
""" + ",\n".join(f"round({_D.format(j + 1)} - {_D.format(4)}, 6) AS l_discount_ns{j + 2}" for j in range(3)) + """
FROM lineitem, q""")
def q_spline_basis(spark, sf):
    """M6: natural-spline basis of discount (knots at exact quantiles)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return finish(spline_basis(li, "l_discount", 4))


@register("fold_metrics", """
WITH f AS (SELECT o_totalprice AS y, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders),
m AS (SELECT f.fold, f.y, (SELECT avg(g.y) FROM f g WHERE g.fold <> f.fold) AS p FROM f),
r AS (SELECT fold, sqrt(avg((y - p) ** 2)) AS rmse FROM m GROUP BY 1)
SELECT 'mean' AS model, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse) / sqrt(count(*)), 6) AS std_err, count(*) AS n FROM r""")
def q_fold_metrics(spark, sf):
    """M2 + M26: mean and standard error over five stratified folds of the
    RMSE of the training folds' mean."""
    o = stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("y")),
                         "o_orderstatus", 5, "o_orderkey")
    by = o.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    whole = Window.partitionBy()                       # one row per fold
    means = by.select("fold", ((F.sum("s").over(whole) - F.col("s")) / (F.sum("n").over(whole) - F.col("n"))).alias("p"))
    rmse = (o.join(means, "fold").groupBy("fold").agg(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"))
            .withColumn("model", F.lit("mean")))
    return finish(fold_summary(rmse, ["model"]))


@register("blend_scoring", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 1500 AS by_quantity, (1 - l_discount) * 40000 AS by_discount FROM lineitem),
s AS (SELECT *, 100 + 0.75 * by_quantity + 0.25 * by_discount AS blend FROM l)
SELECT model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(rsq, 6) AS rsq FROM (
  SELECT 'by_quantity' AS model, sqrt(avg((by_quantity - y) ** 2)) AS rmse, avg(abs(by_quantity - y)) AS mae, corr(by_quantity, y) ** 2 AS rsq FROM s
  UNION ALL SELECT 'by_discount', sqrt(avg((by_discount - y) ** 2)), avg(abs(by_discount - y)), corr(by_discount, y) ** 2 FROM s
  UNION ALL SELECT 'blend', sqrt(avg((blend - y) ** 2)), avg(abs(blend - y)), corr(blend, y) ** 2 FROM s)""")
def q_blend_scoring(spark, sf):
    """M18 + M19 + M22: a stack with given weights scores rows; errors of the members and the blend."""
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("by_quantity"),
                                             ((1 - F.col("l_discount")) * 40000).alias("by_discount"))
    blend = StackModel(["by_quantity", "by_discount"], [0.75, 0.25], 100.0, 0.0, [])
    return finish(regression_metrics(blend.transform(li, "blend"), "y", ["by_quantity", "by_discount", "blend"]))


@register("gram_matrix", """
WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c FROM lineitem)
SELECT pair, round(value, 6) AS value FROM (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc,
       CAST(count(*) AS DOUBLE) AS n FROM l) UNPIVOT (value FOR pair IN (aa, ab, ac, bb, bc, cc, n))""")
def q_gram_matrix(spark, sf):
    """M5 + M18: cross products of three predictors in one pass (what the
    linear-combination filter and the blend solve)."""
    g, _, n = gram_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    names = [(i, j, "abc"[i] + "abc"[j]) for i in range(3) for j in range(i, 3)]
    rows = [(k, float(g[i, j])) for i, j, k in names] + [("n", float(n))]
    return finish(spark.createDataFrame(rows, "pair string, value double"))


@register("univariate_inference")
def q_univariate_inference(spark, sf):
    """M9: p-values and 95% intervals (Student t) on the per-term table."""
    li = table(spark, sf, "lineitem")
    return finish(univariate_table(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@register("recipe_model")
def q_recipe_model(spark, sf):
    """M3-M5 + M7: fitted recipe (filters over the correlation matrix and Gram
    matrix, then scaling) applied to the lineitem predictors."""
    li = table(spark, sf, "lineitem").withColumn("const_one", F.lit(1.0)) \
        .withColumn("gross", F.col("l_quantity") * 2 + F.col("l_tax"))
    cols = RECIPE_COLS + ["const_one", "gross"]
    rm = recipe(li, cols, zv=True, corr=0.9, lincomb=True, scale=True)
    rows = [(c, rm.dropped.get(c, "kept")) for c in cols]
    return spark.createDataFrame(rows, "column string, status string")
