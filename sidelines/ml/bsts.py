"""Bayesian structural counterfactual per series.

One series per group of ``applyInPandas`` (series are short weekly
sequences; the scale is in the number of series, spread over tasks).

Model (a static-state re-aim of a structural time series): level + trend +
``harmonics`` Fourier pairs of the ``nseasons`` cycle + the regressors, with
AR(1) errors handled by a Cochrane-Orcutt step.  The posterior under a
flat-ish Normal-Inverse-Gamma prior is conjugate, so ``draws`` exact draws of
(beta, sigma^2) are taken without MCMC, with a fixed seed per series, and the
post-period outcome is drawn from the posterior predictive.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

__all__ = ["fit_counterfactual"]


def _design(t: np.ndarray, nseasons: int, harmonics: int, cov: np.ndarray) -> np.ndarray:
    cols = [np.ones_like(t), (t - t.mean()) / max(t.std(), 1.0)]
    for h in range(1, harmonics + 1):
        cols += [np.sin(2 * np.pi * h * t / nseasons), np.cos(2 * np.pi * h * t / nseasons)]
    X = np.column_stack(cols)
    return np.column_stack([X, cov]) if cov.size else X


def _sampler(keys, time_col, y_col, covariates, pre_end, nseasons, harmonics, draws, seed):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        t = pdf[time_col].to_numpy(dtype=float)
        y = pdf[y_col].to_numpy(dtype=float)
        cov = pdf[list(covariates)].to_numpy(dtype=float) if covariates else np.empty((len(pdf), 0))
        X = _design(t, nseasons, harmonics, cov)
        pre = (t <= pre_end) & ~np.isnan(y)
        post = t > pre_end
        Xp, yp = X[pre], y[pre]
        n, p = Xp.shape
        key_vals = [pdf[k].iloc[0] for k in keys]
        rng = np.random.default_rng([seed, zlib.crc32(repr(key_vals).encode())])
        # AR(1) error coefficient from OLS residuals (Cochrane-Orcutt step)
        b0, *_ = np.linalg.lstsq(Xp, yp, rcond=None)
        r = yp - Xp @ b0
        rho = float(np.clip(np.dot(r[1:], r[:-1]) / max(np.dot(r[:-1], r[:-1]), 1e-12), -0.95, 0.95)) if n > 2 else 0.0
        Xs, ys = Xp[1:] - rho * Xp[:-1], yp[1:] - rho * yp[:-1]
        # Normal-Inverse-Gamma posterior (prior precision kappa, IG(a0, b0))
        kappa, a0, bb0 = 1e-4, 1.0, 1.0
        V = np.linalg.inv(Xs.T @ Xs + kappa * np.eye(p))
        m = V @ (Xs.T @ ys)
        a_n = a0 + len(ys) / 2
        b_n = bb0 + 0.5 * (ys @ ys - m @ np.linalg.solve(V, m))
        sig2 = b_n / rng.gamma(a_n, 1.0, size=draws)
        L = np.linalg.cholesky(V + 1e-12 * np.eye(p))
        z = rng.standard_normal((draws, p))
        betas = m + (z @ L.T) * np.sqrt(sig2)[:, None]
        Xq, tq = X[post], t[post]
        mean = betas @ Xq.T                                  # draws x post
        last_resid = (yp[-1] - Xp[-1] @ betas.T) if n else np.zeros(draws)
        eps = rng.standard_normal(mean.shape) * np.sqrt(sig2)[:, None]
        err = np.empty_like(mean)
        prev = last_resid
        for j in range(mean.shape[1]):                       # AR(1) error path
            prev = rho * prev + eps[:, j]
            err[:, j] = prev
        yhat = mean + err
        out = pd.DataFrame({
            "draw": np.repeat(np.arange(1, draws + 1), len(tq)),
            time_col: np.tile(tq.astype("int64"), draws),
            "y_hat": yhat.reshape(-1),
        })
        for k, v in zip(keys, key_vals):
            out.insert(0, k, v)
        return out
    return fn


def fit_counterfactual(df: DataFrame, keys: Sequence[str], time: str, y: str, covariates: Sequence[str] = (),
                       pre_end: int = 74, nseasons: int = 52, harmonics: int = 3, draws: int = 1000,
                       seed: int = 42) -> DataFrame:
    """Posterior predictive draws for the post period: (keys, draw, time, y_hat).
    ``y`` must be NULL (masked) in the post period; ``time`` is the 1-based index."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + ["draw int", f"{time} long", "y_hat double"])
    cols = [*keys, time, y, *covariates]
    fn = _sampler(list(keys), time, y, list(covariates), pre_end, nseasons, harmonics, draws, seed)
    return df.select(*cols).groupBy(*keys).applyInPandas(fn, schema)
