"""Smoothers (M25), the data behind a smoothed curve: local regression with a
fixed bandwidth or by span, and a penalised spline.

For the fixed bandwidth rows are first reduced to one row per distinct x (count, sum y) - the
weights depend on x only - then each grid point meets only the x values
within its bandwidth through a bucketed equi-join (a range join, no
grid x data product), and the weighted least-squares fit is a handful of
weighted sums per grid point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.ml.gram import products_of
from sidelines.operators.scan import Scan, segmented_scan
from sidelines.session import cut_lineage

__all__ = ["local_smooth", "loess", "span_bandwidths", "bspline_basis", "PenalisedSpline", "penalised_spline"]


def local_smooth(df: DataFrame, x: str, y: str, grid: Sequence[float], bandwidth: float,
                 spark: SparkSession | None = None) -> DataFrame:
    """Tricube-weighted local linear fit at each grid point.
    Returns (grid_x, fit, n_eff) - ``fit`` NULL where fewer than two distinct
    x fall inside the bandwidth."""
    spark = spark or df.sparkSession
    h = float(bandwidth)
    pts = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
           .groupBy(F.col(x).cast("double").alias("x"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("sy"))
           .withColumn("bucket", F.floor(F.col("x") / h)))
    g = spark.createDataFrame([(float(v),) for v in grid], "grid_x double") \
        .withColumn("bucket", F.explode(F.array(*[F.floor(F.col("grid_x") / h) + d for d in (-1, 0, 1)])))
    j = g.join(pts, "bucket").where(F.abs(F.col("x") - F.col("grid_x")) < h)
    u = F.abs(F.col("x") - F.col("grid_x")) / h
    j = j.withColumn("w", F.pow(1 - F.pow(u, 3), 3) * F.col("n")).withColumn("dx", F.col("x") - F.col("grid_x"))
    s = j.groupBy("grid_x").agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("dx")).alias("s1"),
        F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("s2"),
        F.sum(F.col("w") * F.col("sy") / F.col("n")).alias("t0"),
        F.sum(F.col("w") * F.col("dx") * F.col("sy") / F.col("n")).alias("t1"),
        F.count(F.lit(1)).alias("n_x"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when((F.col("n_x") >= 2) & (det != 0), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det)
    return s.select("grid_x", fit.alias("fit"), F.col("s0").alias("n_eff"))


def span_bandwidths(pts: DataFrame, grid: Sequence[float], span: float) -> DataFrame:
    """(grid_x, h): distance from each grid point to its q-th nearest row, q = floor(n span) (all rows, times span, above 1).

    ``pts``: (x, n), one row per distinct x.  The q nearest rows are consecutive in
    the order of x, so windows of q consecutive order statistics are formed by a
    join on exact ranks, and the best window of a grid point is one of the two
    whose midpoints lie next to it: a scan over midpoints and grid points together."""
    ranked = segmented_scan(pts.select("x", "n"), [], ["x"], {"hi": Scan("sum", "n")}).withColumn("lo", F.col("hi") - F.col("n") + 1)
    ranked = cut_lineage(ranked)
    total = ranked.agg(F.max("hi").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = pts.sparkSession
    g = spark.createDataFrame([(float(v),) for v in grid], "grid_x double")
    if total["n"] is None:
        return g.withColumn("h", F.lit(None).cast("double"))
    q = min(max(int(math.floor(total["n"] * span + 1e-5)), 1), total["n"])
    # the value at rank lo + q - 1: both sides are cut into rank ranges of the same width, a value that spans several is in each
    width = max(1, -(-total["n"] // 4096))
    at = ranked.select(F.col("x").alias("u"), (F.col("lo") + q - 1).alias("r")).filter(F.col("r") <= total["n"]) \
               .withColumn("b", F.expr(f"r div {width}"))
    to = ranked.select(F.col("x").alias("v"), "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"hi div {width}"))).alias("b"))
    windows = at.join(to, "b").filter((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi"))) \
                .select(((F.col("u") + F.col("v")) / 2).alias("at"), F.lit(None).cast("double").alias("grid_x"), F.struct("u", "v").alias("w"))
    both = windows.unionByName(g.select(F.col("grid_x").alias("at"), "grid_x", F.lit(None).cast("struct<u:double,v:double>").alias("w")))
    found = segmented_scan(both, [], ["at", "w", "grid_x"], {"below": Scan("last", "w"), "above": Scan("last", "w", reverse=True)}).filter("grid_x IS NOT NULL")

    def reach(w: str):
        return F.greatest(F.col("grid_x") - F.col(w)["u"], F.col(w)["v"] - F.col("grid_x"))

    return found.select("grid_x", (F.least(reach("below"), reach("above")) * max(span, 1.0)).alias("h")).distinct()


def _solve3(s, t, keep) -> tuple:
    """First unknown of the normal equations of degree 2, 1 and 0 (moments ``s`` 0 to 4, right sides ``t``), by Cramer's rule."""
    det2 = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    num2 = t[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (t[1] * s[4] - s[3] * t[2]) + s[2] * (t[1] * s[3] - s[2] * t[2])
    det1 = s[0] * s[2] - s[1] * s[1]
    return (F.when((keep >= 3) & (det2 != 0), num2 / det2), F.when((keep >= 2) & (det1 != 0), (s[2] * t[0] - s[1] * t[1]) / det1),
            F.when(keep >= 1, t[0] / s[0]))


def loess(df: DataFrame, x: str, y: str, grid: Sequence[float], span: float = 0.75, degree: int = 2) -> DataFrame:
    """Local regression at each grid point (M25): tricube weights up to the
    distance of the nearest ``span`` of the rows, a local polynomial of
    ``degree`` 0 to 2 fitted directly at the point.

    Returns (grid_x, fit, h).  With fewer distinct x inside than the degree
    needs, the degree falls; h = 0 (the nearest rows all stand at the point)
    gives their mean; no rows give NULL.  Rows with a NULL x or y are left out.
    Every row meets the grid, a short list, inside one scan; only sums by grid point are shuffled."""
    if degree not in (0, 1, 2):
        raise ValueError(degree)
    pts = cut_lineage(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
                      .groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")))
    found = span_bandwidths(pts, sorted(set(map(float, grid))), span).collect()          # one row per grid point
    hs = df.sparkSession.createDataFrame(found, "grid_x double, h double")
    table = F.array(*[F.struct(F.lit(g).alias("grid_x"), F.lit(h).cast("double").alias("h")) for g, h in found])
    near = F.filter(table, lambda g: (F.abs(F.col("x") - g["grid_x"]) < g["h"]) | ((g["h"] == 0) & (F.col("x") == g["grid_x"])))
    rows = pts.select("x", "n", "sy", F.inline(near))
    u = F.when(F.col("h") > 0, (F.col("x") - F.col("grid_x")) / F.col("h")).otherwise(F.lit(0.0))
    rows = rows.withColumn("u", u).withColumn("k", F.pow(1 - F.pow(F.abs("u"), 3), 3))
    sums = rows.groupBy("grid_x").agg(
        *[F.sum(F.col("k") * F.col("n") * F.pow("u", F.lit(p))).alias(f"s{p}") for p in range(5)],
        *[F.sum(F.col("k") * F.col("sy") * F.pow("u", F.lit(p))).alias(f"t{p}") for p in range(3)], F.count(F.lit(1)).alias("nx"))
    fits = _solve3([F.col(f"s{p}") for p in range(5)], [F.col(f"t{p}") for p in range(3)], F.col("nx"))
    fit = sums.select("grid_x", F.coalesce(*fits[2 - degree:]).alias("fit"))
    return hs.join(fit, "grid_x", "left").select("grid_x", "fit", "h")


def bspline_basis(x: np.ndarray, lo: float, hi: float, size: int, degree: int = 3) -> np.ndarray:
    """[rows, size] B-splines of ``degree`` on equally spaced knots over lo..hi; x outside is taken at the end."""
    step = (hi - lo) / (size - degree)
    knots = lo + step * np.arange(-degree, size + 1)
    x = np.clip(x, lo, hi)[:, None]
    cell = np.clip(np.floor((x - lo) / step), 0, size - degree - 1) + degree        # the last interval is closed
    b = (np.arange(len(knots) - 1)[None, :] == cell).astype(float)
    for d in range(1, degree + 1):
        m = len(knots) - 1 - d
        b = (x - knots[:m]) / (d * step) * b[:, :m] + (knots[d + 1:d + 1 + m] - x) / (d * step) * b[:, 1:m + 1]
    return b[:, :size]


@dataclass(frozen=True)
class PenalisedSpline:
    lo: float
    hi: float
    degree: int
    coefficients: np.ndarray
    penalty: float
    edf: float
    gcv: list

    def values(self, x: Sequence[float]) -> np.ndarray:
        if self.hi <= self.lo:
            return np.full(len(x), self.coefficients[0])
        return bspline_basis(np.asarray(x, float), self.lo, self.hi, len(self.coefficients), self.degree) @ self.coefficients

    def curve(self, spark: SparkSession, grid: Sequence[float]) -> DataFrame:
        return spark.createDataFrame([(float(g), float(v)) for g, v in zip(grid, self.values(grid))], "grid_x double, fit double")


def penalised_spline(df: DataFrame, x: str, y: str, penalties: Sequence[float] | None = None, size: int = 10, degree: int = 3,
                     order: int = 2) -> PenalisedSpline | None:
    """Smoother for many rows (M25): B-splines with a penalty on differences of
    ``order`` of neighbouring coefficients; the penalty of least generalised
    cross-validation error among ``penalties``.

    One scan gives the basis' cross products (size x size numbers); every
    penalty is solved from them.  Rows with a NULL x or y are left out; no rows give None,
    and a single x its mean."""
    if size <= max(degree, order):
        raise ValueError("the basis must be larger than its degree and the order of the penalty")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("y").alias("m")).first()
    if ends["lo"] is None:
        return None
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        return PenalisedSpline(lo, hi, degree, np.array([ends["m"]]), 0.0, 1.0, [])
    mid = ends["m"]                                        # y is centred: the basis holds the constants

    def design(v: np.ndarray) -> np.ndarray:
        return np.column_stack([bspline_basis(v[:, 0], lo, hi, size, degree), v[:, 1] - mid])

    a = products_of(rows, ["x", "y"], design)
    n = rows.count()
    gram, right, yy = a[:size, :size], a[:size, size], a[size, size]
    diff = np.diff(np.eye(size), order, axis=0)
    rough = diff.T @ diff
    tried = []
    for lam in penalties if penalties is not None else [10.0 ** e for e in np.linspace(-4, 8, 49)]:
        inner = gram + lam * rough
        c = np.linalg.lstsq(inner, right, rcond=1e-13)[0]
        edf = float(np.trace(np.linalg.lstsq(inner, gram, rcond=1e-13)[0]))
        rss = max(float(yy - 2 * c @ right + c @ gram @ c), 0.0)
        tried.append((n * rss / max(n - edf, 1e-9) ** 2, float(lam), edf, c))
    best = min(tried, key=lambda t: (t[0], -t[1]))
    return PenalisedSpline(lo, hi, degree, best[3] + mid, best[1], best[2], [(t[1], t[2], t[0]) for t in tried])
