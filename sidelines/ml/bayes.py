"""Search over settings by a surrogate (M10): expected improvement under a
Gaussian process proposes batches of settings, Spark evaluates them.

The surrogate sees one point per evaluated setting, a few dozen numbers on the
driver; all fitting and scoring is done by ``evaluate``, which gets a whole
batch so that its fits can run side by side or share scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.ml.tune import latin_hypercube

__all__ = ["bayes_search", "fold_errors", "results_frame"]


def _unit(space: Mapping[str, tuple], configs: Sequence[dict]) -> np.ndarray:
    """Settings in the unit cube."""
    cols = []
    for name, (lo, hi, kind) in space.items():
        v = np.array([c[name] for c in configs], float)
        cols.append((np.log(v) - math.log(lo)) / (math.log(hi) - math.log(lo)) if kind == "log" else (v - lo) / ((hi - lo) or 1.0))
    return np.column_stack(cols)


def _matern(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    r = np.sqrt(5 * np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1), 0.0)) / scale
    return (1 + r + r * r / 3) * np.exp(-r)


def _posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation at ``at``; length scale and noise by marginal likelihood."""
    mid, spread = y.mean(), y.std() or 1.0
    t = (y - mid) / spread
    best = None
    for scale in (0.1, 0.2, 0.4, 0.8, 1.6):
        k = _matern(x, x, scale)
        for noise in (1e-6, 1e-3, 1e-1):
            low = np.linalg.cholesky(k + noise * np.eye(len(t)) + 1e-9 * np.eye(len(t)))
            alpha = np.linalg.solve(low.T, np.linalg.solve(low, t))
            score = -0.5 * t @ alpha - np.log(np.diag(low)).sum()
            if best is None or score > best[0]:
                best = (score, scale, low, alpha)
    _, scale, low, alpha = best
    cross = _matern(at, x, scale)
    v = np.linalg.solve(low, cross.T)
    return cross @ alpha * spread + mid, np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-12)) * spread


_erf = np.vectorize(math.erf)


def _improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    z = (best - mean) / sd
    return (best - mean) * 0.5 * (1 + _erf(z / math.sqrt(2))) + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def propose(space: Mapping[str, tuple], seen: Sequence[dict], errors: Sequence[float], n: int, seed: int, candidates: int = 2000) -> list[dict]:
    """``n`` settings of largest expected improvement over the least error; after each, the surrogate is taken at its word."""
    pool = [c for c in latin_hypercube(space, candidates, seed) if c not in list(seen)]
    at, x, y = _unit(space, pool), _unit(space, seen), np.array(errors, float)
    out = []
    for _ in range(min(n, len(pool))):
        mean, sd = _posterior(x, y, at)
        gain = _improvement(mean, sd, y.min())
        gain[[i for i, c in enumerate(pool) if c in out]] = -np.inf
        i = int(np.argmax(gain))
        out.append(pool[i])
        x, y = np.vstack([x, at[i]]), np.append(y, mean[i])
    return out


def bayes_search(space: Mapping[str, tuple], evaluate: Callable[[list[dict]], list[list[float]]], initial: int = 10, iterations: int = 20,
                 batch: int = 5, seed: int = 42) -> tuple[dict, list[dict]]:
    """Best settings and one record per setting: config, iteration (0: the Latin hypercube), the parameters, mean, std_err, n.

    ``evaluate``: settings -> for each its errors by fold (smaller is better)."""
    records: list[dict] = []

    def take(configs: list[dict], iteration: int) -> None:
        for c, e in zip(configs, evaluate(configs)):
            e = np.asarray(e, float)
            records.append({"config": len(records), "iteration": iteration, **c, "mean": float(e.mean()),
                            "std_err": float(e.std(ddof=1) / np.sqrt(len(e))) if len(e) > 1 else float("nan"), "n": len(e)})

    take(latin_hypercube(space, initial, seed), 0)
    done, turn = 0, 0
    while done < iterations:
        turn += 1
        seen = [{k: r[k] for k in space} for r in records]
        new = propose(space, seen, [r["mean"] for r in records], min(batch, iterations - done), seed + turn)
        if not new:
            break
        take(new, turn)
        done += len(new)
    best = min(records, key=lambda r: (r["mean"], r["config"]))
    return {k: best[k] for k in space}, records


def fold_errors(fit: Callable[[DataFrame, dict], object], df: DataFrame, label: str, fold_col: str, parallelism: int = 4):
    """``evaluate`` for any estimator: ``fit(train, setting)`` returns a model whose ``transform`` adds ``prediction``.

    The fits of a batch (settings x folds) run ``parallelism`` at a time."""
    folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]

    def one(job) -> float:
        setting, f = job
        model = fit(df.where(F.col(fold_col) != f), setting)
        e = F.col("prediction") - F.col(label)
        return float(model.transform(df.where(F.col(fold_col) == f)).agg(F.sqrt(F.avg(e * e))).first()[0])

    def evaluate(settings: list[dict]) -> list[list[float]]:
        jobs = [(s, f) for s in settings for f in folds]
        with ThreadPoolExecutor(parallelism) as pool:
            errors = list(pool.map(one, jobs))
        return [errors[i:i + len(folds)] for i in range(0, len(errors), len(folds))]

    return evaluate


def results_frame(spark: SparkSession, space: Mapping[str, tuple], records: Sequence[dict]) -> DataFrame:
    """The records as a table."""
    schema = "config int, iteration int, " + ", ".join(f"{p} double" for p in space) + ", mean double, std_err double, n int"
    rows = [(r["config"], r["iteration"], *[float(r[p]) for p in space], r["mean"], r["std_err"], r["n"]) for r in records]
    return spark.createDataFrame(rows, schema)
