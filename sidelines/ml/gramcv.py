"""Cross-validated elastic net, lasso and ridge from fold moments.

One scan gives the cross products of every fold (:func:`sidelines.ml.gram.moments`).
What a fit needs of the other folds is the total minus the fold, so all
penalties, mixtures and folds are solved without reading the data again, and
the error on the fold left out follows from its own moments.  The work after
the scan is p x p, whatever the number of rows.

The objective is that of MLlib's ``LinearRegression`` (and of glmnet): columns
and label are scaled by their standard deviations (divisor n),

    1/(2n) |y - Xb|^2 + penalty / sd(y) * (mixture |b|_1 + (1 - mixture)/2 |b|^2),

and the intercept is not penalised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.ml.gram import Moments, moments

__all__ = ["LinearFit", "solve", "cross_validate", "fit_linear", "linear_folds"]


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float
    penalty: float
    mixture: float

    def predict(self) -> Column:
        """The prediction as a column expression; NULL where a feature is NULL."""
        out = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coefficients):
            if b:
                out = out + F.col(c) * F.lit(float(b))
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict())

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Predictions of a matrix of the features; NaN where a feature that counts is missing."""
        on = np.flatnonzero(self.coefficients)
        return x[:, on] @ self.coefficients[on] + self.intercept


def _on_active(a: np.ndarray, c: np.ndarray, l1: float, l2: float, b: np.ndarray) -> np.ndarray | None:
    """The exact minimum if it has the signs of ``b``: a linear system on the non-zero coordinates, then the optimality conditions."""
    on = np.flatnonzero(b)
    out = np.zeros(len(b))
    if len(on):
        try:
            out[on] = np.linalg.solve(a[np.ix_(on, on)] + l2 * np.eye(len(on)), c[on] - l1 * np.sign(b[on]))
        except np.linalg.LinAlgError:
            return None
        if (np.sign(out[on]) != np.sign(b[on])).any():
            return None
    grad = c - a @ out - l2 * out
    slack = 1e-9 * (1 + np.abs(c).max())
    off = np.ones(len(b), bool)
    off[on] = False
    if (np.abs(grad[off]) > l1 + slack).any() or (np.abs(grad[on] - l1 * np.sign(out[on])) > slack).any():
        return None
    return out


def _descend(a: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray, most: int = 4000, tol: float = 1e-11) -> np.ndarray:
    """Minimum of 1/2 b'ab - c'b + l1 |b|_1 + l2/2 |b|^2: coordinate descent
    finds the signs, a linear system the values.  Collinear columns, where
    that system has no single answer, are descended on to the end."""
    b = start.copy()
    grad = c - a @ b
    diag = np.diag(a)
    active = np.flatnonzero(diag > 0)
    for sweep in range(most):
        change = 0.0
        for j in active:
            rho = grad[j] + diag[j] * b[j]
            new = max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            step = (new if rho >= 0 else -new) - b[j]
            if step:
                grad -= a[:, j] * step
                b[j] += step
                change = max(change, abs(step))
        if change < tol:
            break
        if sweep % 10 == 9:
            exact = _on_active(a, c, l1, l2, b)
            if exact is not None:
                return exact
    return b


def solve(m: Moments, penalty: float, mixture: float, start: np.ndarray | None = None) -> tuple[LinearFit, np.ndarray]:
    """Fit of the last column of ``m`` on the others, and its scaled coefficients (a start for a near penalty)."""
    p = len(m.cols) - 1
    centred, means = m.centred, m.means
    sd = np.sqrt(np.maximum(np.diag(centred), 0.0) / m.n)
    sd = np.where(sd > 1e-12 * (1 + np.abs(means)), sd, 0.0)
    b = np.zeros(p)
    if sd[p] > 0 and (sd[:p] > 0).any():
        scale = np.where(sd > 0, sd, 1.0)
        z = centred / np.outer(scale, scale) / m.n
        a, c = z[:p, :p] * np.outer(sd[:p] > 0, sd[:p] > 0), z[:p, p] * (sd[:p] > 0)
        lam = penalty / sd[p]
        if mixture == 0 and lam > 0:
            b = np.linalg.solve(a + lam * np.eye(p), c)
        elif lam == 0:
            b = np.linalg.lstsq(a, c, rcond=1e-12)[0]
        else:
            b = _descend(a, c, lam * mixture, lam * (1 - mixture), np.zeros(p) if start is None else start)
        coef = b * sd[p] / scale[:p]
    else:
        coef = np.zeros(p)
    return LinearFit(m.cols[:p], coef, float(means[p] - coef @ means[:p]), penalty, mixture), b


def _errors(fit: LinearFit, m: Moments) -> tuple[float, float]:
    """Root mean square error and squared correlation of a fit on the rows of ``m``."""
    p = len(m.cols) - 1
    # sum (y - u - b'x)^2 with x and y shifted, u the intercept for them
    u = fit.intercept + fit.coefficients @ m.shift[:p] - m.shift[p]
    w = np.concatenate([[-u], -fit.coefficients, [1.0]])
    sse = max(float(w @ m.a @ w), 0.0)
    centred = m.centred
    with np.errstate(divide="ignore", invalid="ignore"):
        rsq = (fit.coefficients @ centred[:p, p]) ** 2 / ((fit.coefficients @ centred[:p, :p] @ fit.coefficients) * centred[p, p])
    return float(np.sqrt(sse / m.n)), float(rsq) if np.isfinite(rsq) else float("nan")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, fold_col: str,
                   grid: Sequence[tuple[float, float]]) -> tuple[LinearFit, list[tuple]]:
    """Best refit on all folds, and (config, penalty, mixture, fold, rmse, rsq) of every configuration and fold.

    ``grid``: (penalty, mixture) pairs.  Rows with a NULL feature or label are left out.  Folds without rows do not count."""
    by_fold = moments(df, [*features, label], fold_col)
    if not by_fold:
        raise ValueError("no complete rows")
    total = None
    for m in by_fold.values():
        total = m if total is None else total + m
    results: list[tuple] = []
    falling = sorted(range(len(grid)), key=lambda i: (grid[i][1], -grid[i][0]))
    for fold, held in sorted(by_fold.items()):
        if held.n == 0 or total.n - held.n < 2:
            continue
        train, start, last = total - held, None, None
        for i in falling:
            penalty, mixture = grid[i]
            fit, b = solve(train, penalty, mixture, start if last == mixture else None)
            start, last = b, mixture
            results.append((i, float(penalty), float(mixture), int(fold), *_errors(fit, held)))
    mean = {i: np.mean([r[4] for r in results if r[0] == i]) for i in range(len(grid))}
    best = min(range(len(grid)), key=lambda i: (mean[i], i))
    return solve(total, *grid[best])[0], sorted(results)


def fit_linear(df: DataFrame, features: Sequence[str], label: str, penalty: float = 0.0, mixture: float = 0.0) -> LinearFit:
    """One fit from one scan."""
    m = moments(df, [*features, label])
    if not m:
        raise ValueError("no complete rows")
    return solve(m[0], penalty, mixture)[0]


def linear_folds(df: DataFrame, features: Sequence[str], label: str, fold_col: str, left_out: Sequence[int | None], penalty: float = 0.0,
                 mixture: float = 0.0) -> list[LinearFit]:
    """A fit without each fold of ``left_out`` (None: on all rows), all from one scan."""
    by_fold = moments(df, [*features, label], fold_col)
    if not by_fold:
        raise ValueError("no complete rows")
    total = None
    for m in by_fold.values():
        total = m if total is None else total + m
    return [solve(total - by_fold[f] if f in by_fold else total, penalty, mixture)[0] for f in left_out]


RESULT = "config int, penalty double, mixture double, fold int, rmse double, rsq double"
