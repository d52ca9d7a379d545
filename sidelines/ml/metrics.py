"""Regression metrics (M8, M19, M23, M26) and the univariate table (M9)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.nulls import safe_corr
from sidelines.operators.reshape import append, pivot_wider

__all__ = ["regression_metrics", "compare_models", "univariate_table", "t_cdf", "t_quantile", "fold_summary"]


def regression_metrics(df: DataFrame, truth: str, preds: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M8: one aggregation pass; rows (keys, model, rmse, mae, rsq) where
    ``rsq`` is the squared Pearson correlation (not 1 - SSE/SST)."""
    y = F.col(truth)
    found = [F.struct((F.sqrt(F.avg((F.col(p) - y) * (F.col(p) - y)))).alias("rmse"), F.avg(F.abs(F.col(p) - y)).alias("mae"),
                      F.pow(safe_corr(p, truth), 2).alias("rsq"), F.lit(p).alias("model")) for p in preds]
    m = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.array(*found).alias("m"))
    return m.select(*keys, F.inline("m"))


def compare_models(train_metrics: DataFrame, test_metrics: DataFrame, metric: str = "rmse",
                   labels: dict | None = None) -> DataFrame:
    """Train and test metric side by side, one row per model, with a
    display label and an ordinal for sorting."""
    t = append(train_metrics.withColumn("split", F.lit("train")), test_metrics.withColumn("split", F.lit("test")))
    wide = pivot_wider(t, ["model"], "split", ["train", "test"], metric, prefix=f"{metric}_")
    if labels:
        m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        wide = wide.withColumn("label", F.coalesce(F.try_element_at(m, F.col("model")), F.col("model")))
    return wide


# --- Student t distribution (regularised incomplete beta, continued fraction)

def _betacf(a, b, x, iters=300, eps=1e-15):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(c) > 1e-300 else 1.0 + aa / 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(c) > 1e-300 else 1.0 + aa / 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def _betainc(a, b, x):
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * _betainc(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def univariate_table(df: DataFrame, y: str, xs: Sequence[str], level: float = 0.95,
                     inference: bool = True) -> DataFrame:
    """M9: one Gaussian regression of ``y`` on each predictor alone.

    The frame is unpivoted to (term, x, y) and every fit is a handful of
    algebraic aggregates (``regr_*``) in one ``groupBy(term)``.  The t-based
    p-value and interval are computed on the tiny per-term table with a
    pandas function (one row per predictor)."""
    long = df.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double") for c in xs]) \
        .unpivot(["_y"], list(xs), "term", "_x")
    fit = long.groupBy("term").agg(
        F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"),
        F.regr_sxy("_y", "_x").alias("sxy"), F.regr_count("_y", "_x").alias("n"))
    se = F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    fit = fit.withColumn("se", se).withColumn("t_stat", F.col("beta") / F.col("se")) \
             .select("term", "beta", "intercept", "se", "t_stat", "n")
    if not inference:
        return fit

    def infer(it):
        for pdf in it:
            dfree = (pdf["n"] - 2).astype(float)
            pdf["p_value"] = [2 * (1 - t_cdf(abs(t), d)) if d > 0 and np.isfinite(t) else np.nan
                              for t, d in zip(pdf["t_stat"], dfree)]
            q = [t_quantile(0.5 + level / 2, d) if d > 0 else np.nan for d in dfree]
            pdf["lo"] = pdf["beta"] - np.array(q) * pdf["se"]
            pdf["hi"] = pdf["beta"] + np.array(q) * pdf["se"]
            yield pdf
    schema = "term string, beta double, intercept double, se double, t_stat double, n long, " \
             "p_value double, lo double, hi double"
    return fit.mapInPandas(infer, schema)


def fold_summary(results: pd.DataFrame | DataFrame, keys: Sequence[str], metric: str = "rmse") -> DataFrame:
    """Mean and standard error of a metric over folds per configuration."""
    return results.groupBy(*keys).agg(
        F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(F.lit(1)))).alias("std_err"),
        F.count(F.lit(1)).alias("n"))
