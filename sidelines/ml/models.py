"""Regressors (M11-M15, M17) as Spark ML fits.

MLlib covers boosted trees, elastic net / lasso / ridge and random forests.
The RBF support-vector regressor and the bagged MLP are not in MLlib and are
re-aimed: random Fourier features + Huber-loss linear fit, and a full-batch
MLP whose gradients are partial sums computed per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["fit_gbt", "fit_enet", "fit_lasso", "fit_ridge", "fit_forest", "fit_rff_svr", "fit_bagged_mlp",
           "assembled", "RFFModel", "BaggedMLPModel"]


def assembled(features: Sequence[str], est, label: str) -> Pipeline:
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    est.setFeaturesCol("features").setLabelCol(label)
    return Pipeline(stages=[va, est])


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, tree_depth: int = 4,
            min_n: int = 1, loss_reduction: float = 0.0, sample_size: float = 1.0, mtry: str = "all",
            learn_rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees (trees, tree_depth, min_n, loss_reduction,
    sample_size, mtry, learn_rate)."""
    est = GBTRegressor(maxIter=trees, maxDepth=tree_depth, minInstancesPerNode=min_n, minInfoGain=loss_reduction,
                       subsamplingRate=sample_size, featureSubsetStrategy=mtry, stepSize=learn_rate, seed=seed)
    return assembled(features, est, label).fit(df)


def fit_enet(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.01,
             mixture: float = 0.5) -> PipelineModel:
    """Elastic net (penalty = regParam, mixture = elasticNetParam);
    predictors standardised internally like the source's recipe."""
    est = LinearRegression(regParam=penalty, elasticNetParam=mixture, standardization=True, maxIter=200)
    return assembled(features, est, label).fit(df)


def fit_lasso(df, features, label, penalty: float = 0.01) -> PipelineModel:
    """The model the source calls ridge has mixture 1, i.e. a lasso (Q6)."""
    return fit_enet(df, features, label, penalty, 1.0)


def fit_ridge(df, features, label, penalty: float = 0.01) -> PipelineModel:
    """True ridge (mixture 0), offered next to the lasso."""
    return fit_enet(df, features, label, penalty, 0.0)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 200, mtry: str = "onethird",
               min_n: int = 5, seed: int = 42) -> PipelineModel:
    """Random forest (trees, mtry, min_n)."""
    est = RandomForestRegressor(numTrees=trees, featureSubsetStrategy=mtry, minInstancesPerNode=min_n, seed=seed)
    return assembled(features, est, label).fit(df)


def _standardise(df: DataFrame, features: Sequence[str]):
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    means = np.array([row[f"m{i}"] or 0.0 for i in range(len(features))])
    stds = np.array([row[f"s{i}"] or 1.0 for i in range(len(features))])
    stds[stds == 0] = 1.0
    return means, stds


@dataclass
class RFFModel:
    features: list
    means: np.ndarray
    stds: np.ndarray
    W: np.ndarray
    b: np.ndarray
    linear: PipelineModel

    def rff(self, df: DataFrame) -> DataFrame:
        z = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(s)
             for c, m, s in zip(self.features, self.means, self.stds)]
        D = self.W.shape[1]
        cols = {}
        for j in range(D):
            lin = F.lit(float(self.b[j]))
            for i, zi in enumerate(z):
                lin = lin + zi * F.lit(float(self.W[i, j]))
            cols[f"_rff{j}"] = F.lit(float(np.sqrt(2.0 / D))) * F.cos(lin)
        return df.withColumns(cols)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.linear.transform(self.rff(df))
        return out.drop(*[f"_rff{j}" for j in range(self.W.shape[1])], "features")


def fit_rff_svr(df: DataFrame, features: Sequence[str], label: str, n_components: int = 64,
                gamma: float | None = None, epsilon: float = 1.35, penalty: float = 0.0,
                seed: int = 42) -> RFFModel:
    """M15 re-aimed: RBF kernel approximated by random Fourier features
    (Rahimi & Recht), fitted with a robust Huber loss.  Features are column
    expressions, so scoring stays in whole-stage codegen."""
    features = list(features)
    means, stds = _standardise(df, features)
    p = len(features)
    gamma = gamma if gamma is not None else 1.0 / p
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2 * gamma), size=(p, n_components))
    b = rng.uniform(0, 2 * np.pi, size=n_components)
    shell = RFFModel(features, means, stds, W, b, None)
    zcols = [f"_rff{j}" for j in range(n_components)]
    lr = LinearRegression(loss="huber", epsilon=max(epsilon, 1.0 + 1e-9), regParam=penalty, maxIter=200)
    shell.linear = assembled(zcols, lr, label).fit(shell.rff(df))
    return shell


# ------------------------------------------------------------ bagged MLP

_POISSON1_CDF = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(12)])


def _poisson_weights(rid: np.ndarray, bags: int, seed: int) -> np.ndarray:
    """Poisson(1) bootstrap weight per (row, bag) from a hash of the row id."""
    out = np.empty((len(rid), bags))
    with np.errstate(over="ignore"):
        for b in range(bags):
            h = (rid.astype(np.uint64) * np.uint64(6364136223846793005)
                 + np.uint64((seed * 1000003 + b + 1) * 1442695040888963407 % (1 << 64)))
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xff51afd7ed558ccd)
            h ^= h >> np.uint64(33)
            u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            out[:, b] = np.searchsorted(_POISSON1_CDF, u)
    return out


def _unpack(theta: np.ndarray, p: int, h: int):
    W1 = theta[:p * h].reshape(p, h)
    b1 = theta[p * h:p * h + h]
    W2 = theta[p * h + h:p * h + 2 * h]
    b2 = theta[-1]
    return W1, b1, W2, b2


@dataclass
class BaggedMLPModel:
    features: list
    means: np.ndarray
    stds: np.ndarray
    hidden: int
    thetas: np.ndarray               # bags x n_params
    y_mean: float
    y_std: float

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        p, h = len(self.features), self.hidden
        thetas, means, stds, ym, ys = self.thetas, self.means, self.stds, self.y_mean, self.y_std

        @F.pandas_udf(T.DoubleType())
        def predict(*cols: pd.Series) -> pd.Series:
            X = (np.column_stack([c.astype(float).fillna(m).to_numpy() for c, m in zip(cols, means)]) - means) / stds
            preds = []
            for th in thetas:
                W1, b1, W2, b2 = _unpack(th, p, h)
                preds.append(np.tanh(X @ W1 + b1) @ W2 + b2)
            return pd.Series(np.mean(preds, axis=0) * ys + ym)
        return df.withColumn(out, predict(*[F.col(c) for c in self.features]))


def fit_bagged_mlp(df: DataFrame, features: Sequence[str], label: str, hidden: int = 8, bags: int = 10,
                   epochs: int = 60, learn_rate: float = 0.05, penalty: float = 1e-3, seed: int = 42,
                   key: Sequence[str] | None = None) -> BaggedMLPModel:
    """M17 re-aimed: ``bags`` one-hidden-layer MLPs on Poisson(1) bootstrap
    weights, trained by full-batch Adam.  Each epoch is one distributed pass:
    every partition returns its gradient partial sums (parameters x bags
    numbers, independent of the data size), which are summed per bag.  The
    prediction is the mean over bags."""
    features = list(features)
    p, h = len(features), hidden
    n_par = p * h + 2 * h + 1
    means, stds = _standardise(df, features)
    yrow = df.agg(F.avg(label).alias("m"), F.stddev_samp(label).alias("s")).first()
    ym, ys = float(yrow["m"] or 0.0), float(yrow["s"] or 1.0) or 1.0
    key_cols = list(key) if key else [*features, label]
    data = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y"),
                     F.xxhash64(*key_cols).alias("_rid")).where(F.col("_y").isNotNull()).persist()
    rng = np.random.default_rng(seed)
    thetas = rng.normal(0, 0.3, size=(bags, n_par))
    thetas[:, -1] = 0.0
    m1, m2 = np.zeros_like(thetas), np.zeros_like(thetas)
    schema = "bag int, j int, g double"
    for epoch in range(1, epochs + 1):
        th = thetas.copy()

        def grad(it, th=th):
            acc = np.zeros((bags, n_par + 1))
            for pdf in it:
                X = (np.column_stack([pdf[c].fillna(m).to_numpy() for c, m in zip(features, means)]) - means) / stds
                y = (pdf["_y"].to_numpy() - ym) / ys
                wts = _poisson_weights(pdf["_rid"].to_numpy(), bags, seed)
                for b in range(bags):
                    W1, b1, W2, b2 = _unpack(th[b], p, h)
                    a = np.tanh(X @ W1 + b1)
                    r = (a @ W2 + b2 - y) * wts[:, b]
                    dz = np.outer(r, W2) * (1 - a * a)
                    acc[b, :n_par] += np.concatenate([(X.T @ dz).ravel(), dz.sum(0), a.T @ r, [r.sum()]])
                    acc[b, n_par] += wts[:, b].sum()
            rows = [(b, j, float(acc[b, j])) for b in range(bags) for j in range(n_par + 1)]
            yield pd.DataFrame(rows, columns=["bag", "j", "g"])
        sums = data.mapInPandas(grad, schema).groupBy("bag", "j").agg(F.sum("g").alias("g")).collect()
        G = np.zeros((bags, n_par + 1))
        for r in sums:
            G[r["bag"], r["j"]] = r["g"]
        g = 2 * G[:, :n_par] / np.maximum(G[:, n_par:], 1.0) + 2 * penalty * thetas
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        thetas = thetas - learn_rate * (m1 / (1 - 0.9 ** epoch)) / (np.sqrt(m2 / (1 - 0.999 ** epoch)) + 1e-8)
    data.unpersist()
    return BaggedMLPModel(features, means, stds, hidden, thetas, ym, ys)
