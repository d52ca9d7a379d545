"""Stacking (M18, M19): out-of-fold member predictions blended by a
non-negative lasso chosen over a penalty path.

The blend only needs per-fold Gram matrices of the member predictions
(members x members numbers per fold), computed in one grouped aggregation;
the coordinate descent runs on those small matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.operators.reshape import append

__all__ = ["FoldModels", "oof_predictions", "fit_stack", "StackModel", "penalty_path"]


def penalty_path(lo: float = -2, hi: float = -0.5, n: int = 20) -> list[float]:
    """``10 ^ seq(lo, hi, length = n)``."""
    return [float(10 ** v) for v in np.linspace(lo, hi, n)]


@dataclass
class FoldModels:
    """One family fitted without each fold (None: on all rows); a model's ``of_rows`` predicts a matrix of ``features``."""
    features: tuple[str, ...]
    fold_col: str
    models: dict

    @classmethod
    def fit(cls, fit_folds: Callable, df: DataFrame, features: Sequence[str], fold_col: str, left_out: Sequence[int | None]) -> FoldModels:
        """``fit_folds(df, fold_col, left_out)`` gives the models in the order of ``left_out``."""
        return cls(tuple(features), fold_col, dict(zip(left_out, fit_folds(df, fold_col, left_out))))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Predictions of the model of all rows."""
        model = self.models[None]

        @F.pandas_udf("double")
        def predict(*cols: pd.Series) -> pd.Series:
            return pd.Series(model.of_rows(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn(out, predict(*[F.col(c).cast("double") for c in self.features]))

    def out_of_fold(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Every row's prediction by the model that has not seen its fold; one scan for all folds."""
        models = self.models

        @F.pandas_udf("double")
        def predict(fold: pd.Series, *cols: pd.Series) -> pd.Series:
            x, found = np.column_stack([c.to_numpy(float) for c in cols]), np.full(len(fold), np.nan)
            for f in fold.dropna().unique():
                mine = (fold == f).to_numpy()
                found[mine] = models[int(f)].of_rows(x[mine])
            return pd.Series(found)

        return df.withColumn(out, predict(F.col(self.fold_col).cast("int"), *[F.col(c).cast("double") for c in self.features]))


def oof_predictions(df: DataFrame, fold_col: str, members: Mapping[str, Callable | FoldModels], key: Sequence[str],
                    n_folds: int, parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions: member ``fit(train_df)`` returns a model whose
    ``transform`` adds ``prediction``.  Returns wide (key, fold, one column per member).

    The fits (members x folds) run ``parallelism`` at a time; predictions are
    stacked by row and pivoted once, so the plan does not grow by a join per fit.
    Where all members are fitted already (:class:`FoldModels`), rows are scored in
    one scan, without a shuffle; rows that share a key are scored each by itself."""
    if members and all(isinstance(m, FoldModels) for m in members.values()):
        for name, m in members.items():
            df = m.out_of_fold(df.where(F.col(fold_col).between(0, n_folds - 1)), name)
        return df.select(*key, fold_col, *members)

    def one(job) -> DataFrame:
        name, f = job
        train, hold = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        return members[name](train).transform(hold).select(*key, F.lit(f).alias(fold_col), F.lit(name).alias("_member"),
                                                           F.col("prediction").cast("double").alias("_p"))

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, [(name, f) for name in members for f in range(n_folds)]))
    long = append(*parts)
    return long.groupBy(*key, fold_col).agg(*[F.max(F.when(F.col("_member") == name, F.col("_p"))).alias(name) for name in members])


def _nn_lasso(Sxx: np.ndarray, Sxy: np.ndarray, n: float, lam: float, iters: int = 500) -> np.ndarray:
    m = len(Sxy)
    w = np.zeros(m)
    A, c = Sxx / n, Sxy / n
    for _ in range(iters):
        w_old = w.copy()
        for j in range(m):
            if A[j, j] <= 0:
                w[j] = 0.0
                continue
            rho = c[j] - A[j] @ w + A[j, j] * w[j]
            w[j] = max(0.0, rho - lam) / A[j, j]
        if np.max(np.abs(w - w_old)) < 1e-10:
            break
    return w


@dataclass
class StackModel:
    members: list
    weights: np.ndarray
    intercept: float
    penalty: float
    cv_rmse: list

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        pred = F.lit(self.intercept)
        for m, w in zip(self.members, self.weights):
            pred = pred + F.col(m) * F.lit(float(w))
        return df.withColumn(out, pred)

    def coefficients(self, spark) -> DataFrame:
        rows = [(m, float(w)) for m, w in zip(self.members, self.weights)]
        return spark.createDataFrame(rows, "member string, weight double")


def fit_stack(oof: DataFrame, members: Sequence[str], truth: str, penalties: Sequence[float],
              fold_col: str = "fold") -> StackModel:
    """Choose the penalty by fold-wise error of the non-negative blend,
    refit on all folds."""
    members = list(members)
    m = len(members)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(truth).alias("sy"), F.sum(F.col(truth) * F.col(truth)).alias("syy")]
    aggs += [F.sum(c).alias(f"s{i}") for i, c in enumerate(members)]
    aggs += [F.sum(F.col(c) * F.col(truth)).alias(f"c{i}") for i, c in enumerate(members)]
    aggs += [F.sum(F.col(members[i]) * F.col(members[j])).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]
    rows = oof.groupBy(fold_col).agg(*aggs).collect()

    def mats(rs):
        n = sum(r["n"] for r in rs)
        sy = sum(r["sy"] for r in rs)
        syy = sum(r["syy"] for r in rs)
        s = np.array([sum(r[f"s{i}"] for r in rs) for i in range(m)])
        c = np.array([sum(r[f"c{i}"] for r in rs) for i in range(m)])
        G = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                G[i, j] = G[j, i] = sum(r[f"g{i}_{j}"] for r in rs)
        return n, sy, syy, s, c, G

    def fit(n, sy, s, c, G, lam):
        Sxx = G - np.outer(s, s) / n
        Sxy = c - s * sy / n
        w = _nn_lasso(Sxx, Sxy, n, lam)
        return w, (sy - s @ w) / n

    def sse(n, sy, syy, s, c, G, w, a):
        # sum (y - a - Xw)^2 from sufficient statistics
        return syy + n * a * a + w @ G @ w - 2 * a * sy - 2 * w @ c + 2 * a * (s @ w)

    cv = []
    for lam in penalties:
        err, cnt = 0.0, 0
        for k, r in enumerate(rows):
            tr = mats([x for j, x in enumerate(rows) if j != k])
            w, a = fit(tr[0], tr[1], tr[3], tr[4], tr[5], lam)
            te = mats([r])
            err += sse(te[0], te[1], te[2], te[3], te[4], te[5], w, a)
            cnt += te[0]
        cv.append(float(np.sqrt(max(err, 0.0) / max(cnt, 1))))
    best = penalties[int(np.argmin(cv))]
    n, sy, syy, s, c, G = mats(rows)
    w, a = fit(n, sy, s, c, G, best)
    return StackModel(members, w, float(a), float(best), cv)
