"""Preprocessing recipe (M3-M7): zero-variance, correlation and linear
combination filters, natural-spline basis, centring and scaling.

Every statistic is one distributed aggregation over the data; only the
resulting p x p matrices (p = number of predictors) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.ml.gram import moments, pairwise_correlations
from sidelines.operators.aggregates import quantiles

__all__ = ["RecipeModel", "recipe", "zero_variance", "corr_matrix", "gram_matrix", "corr_filter",
           "lincomb_filter", "spline_basis"]


def zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M3: one row per column with its min, max and a zero-variance flag."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").cast("double").alias("min"),
                 F.col(f"{c}__max").cast("double").alias("max"),
                 F.coalesce(F.col(f"{c}__min") == F.col(f"{c}__max"), F.lit(True)).alias("zero_var"))
        for c in cols])).alias("s")).select("s.*")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs (rows that have both) from one scan of matrix products."""
    return pairwise_correlations(df, cols)


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of cross products, column sums and n over the complete rows, from one scan of matrix products."""
    m = moments(df, cols)
    if not m:
        return np.zeros((len(cols), len(cols))), np.zeros(len(cols)), 0
    g, s = m[0].raw
    return g, s, int(m[0].n)


def corr_filter(cm: np.ndarray, cols: Sequence[str], threshold: float = 0.9) -> list[str]:
    """M4: greedy removal; while some |corr| exceeds the threshold, drop the
    member of the worst pair with the larger mean absolute correlation."""
    keep = list(range(len(cols)))
    a = np.abs(np.nan_to_num(cm, nan=0.0))
    while len(keep) > 1:
        sub = a[np.ix_(keep, keep)].copy()
        np.fill_diagonal(sub, 0.0)
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        if sub[i, j] <= threshold:
            break
        mi, mj = sub[i].mean(), sub[j].mean()
        keep.pop(i if mi >= mj else j)
    return [cols[k] for k in keep]


def lincomb_filter(g: np.ndarray, s: np.ndarray, n: int, cols: Sequence[str], tol: float = 1e-9) -> list[str]:
    """M5: drop columns that are exact linear combinations of earlier ones
    (with an intercept), via the eigen-decomposition of the centred Gram matrix."""
    cov = g - np.outer(s, s) / max(n, 1)
    keep: list[int] = []
    for k in range(len(cols)):
        trial = keep + [k]
        sub = cov[np.ix_(trial, trial)]
        scale = np.sqrt(np.clip(np.diag(sub), 1e-300, None))
        ev = np.linalg.eigvalsh(sub / np.outer(scale, scale))
        if ev.min() > tol:
            keep.append(k)
    return [cols[k] for k in keep]


@dataclass
class RecipeModel:
    columns: list[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Drop filtered columns; centre and scale the kept ones (M7)."""
        drop = [c for c in self.dropped if c in df.columns]
        out = df.drop(*drop)
        if self.means:
            out = out.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c] or 1.0)
                                   for c in self.columns})
        return out


def recipe(df: DataFrame, cols: Sequence[str], zv: bool = True, corr: float | None = 0.9,
           lincomb: bool = True, scale: bool = False) -> RecipeModel:
    cols = list(cols)
    dropped: dict[str, str] = {}
    if zv:
        for r in zero_variance(df, cols).collect():
            if r["zero_var"]:
                dropped[r["column"]] = "zero_variance"
        cols = [c for c in cols if c not in dropped]
    if corr is not None and len(cols) > 1:
        kept = corr_filter(corr_matrix(df, cols), cols, corr)
        dropped.update({c: "correlation" for c in cols if c not in kept})
        cols = kept
    if lincomb and len(cols) > 1:
        g, s, n = gram_matrix(df, cols)
        kept = lincomb_filter(g, s, n, cols)
        dropped.update({c: "linear_combination" for c in cols if c not in kept})
        cols = kept
    means, stds = {}, {}
    if scale and cols:
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
        means = {c: row[f"m_{c}"] for c in cols}
        stds = {c: row[f"s_{c}"] for c in cols}
    return RecipeModel(cols, means, stds, dropped)


def spline_basis(df: DataFrame, x: str, df_spline: int = 4, prefix: str | None = None) -> DataFrame:
    """M6: natural cubic spline basis (truncated-power form) with interior
    knots at exact quantiles of ``x``; ``df_spline`` basis columns."""
    prefix = prefix or f"{x}_ns"
    k = df_spline + 1                       # knots incl. boundaries
    probs = {f"k{i}": i / (k - 1) for i in range(k)}
    q = quantiles(df, [], x, probs).select(F.struct(*probs)).scalar()
    knots = [q[f"k{i}"] for i in range(k)]
    xi_last = knots[-1]

    def d(j):
        num = F.pow(F.greatest(F.col(x) - knots[j], F.lit(0.0)), 3) - F.pow(F.greatest(F.col(x) - xi_last, F.lit(0.0)), 3)
        return num / (xi_last - knots[j])
    cols = {f"{prefix}1": F.col(x).cast("double")}
    for j in range(k - 2):
        cols[f"{prefix}{j + 2}"] = d(j) - d(k - 2)
    return df.withColumns(cols)
