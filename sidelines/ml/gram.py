"""Cross products of many columns in one scan.

Every task turns its Arrow batches into matrices and adds up p x p partial
sums by group (a fold, or none); one row per matrix cell leaves a task, and
Spark sums the cells with map-side combining.  Work is a matrix product per
batch, whatever the number of columns: no expression per pair of columns.

The columns are shifted by the values of one row before multiplying, so that
large means do not cost digits; all results are independent of the shift.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["Moments", "moments", "products_of", "pairwise_correlations", "column_means"]

_CELL = pa.schema([("g", pa.int64()), ("m", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


def _shift(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """One value of every column (0 where the row has none)."""
    row = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return np.array([0.0 if row is None or row[i] is None or not np.isfinite(row[i]) else row[i] for i in range(len(cols))])


def _cells(df: DataFrame, cols: Sequence[str], group: str | None, products) -> DataFrame:
    """(g, m, i, j, v): sums over rows of the matrices ``products(x)`` (x: rows x columns, NaN for NULL), by group."""
    p = len(cols)
    key = (F.col(group) if group else F.lit(0)).cast("bigint").alias("g")
    src = df.select(key, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).filter("g IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list[np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            for one in np.unique(g):
                parts = products(x[g == one])
                old = acc.get(int(one))
                acc[int(one)] = parts if old is None else [a + c for a, c in zip(old, parts)]
        for one, parts in acc.items():
            for m, v in enumerate(parts):
                i, j = np.indices(v.shape, dtype=np.int32)
                n = v.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, one)), pa.array(np.full(n, m, np.int32)), pa.array(i.ravel()),
                                                  pa.array(j.ravel()), pa.array(v.ravel())], schema=_CELL)

    return src.mapInArrow(run, "g bigint, m int, i int, j int, v double").groupBy("g", "m", "i", "j").agg(F.sum("v").alias("v"))


def _matrices(cells: DataFrame, shape: dict[int, tuple[int, int]]) -> dict[int, list[np.ndarray]]:
    t = cells.toArrow()
    g, m, i, j, v = (t.column(c).to_numpy() for c in ("g", "m", "i", "j", "v"))
    out: dict[int, list[np.ndarray]] = {}
    for one in np.unique(g):
        out[int(one)] = [np.zeros(shape[k]) for k in shape]
        for k in shape:
            at = (g == one) & (m == k)
            out[int(one)][k][i[at], j[at]] = v[at]
    return out


@dataclass(frozen=True)
class Moments:
    """Sums over complete rows of [1, x - shift]: ``a`` is the (p + 1) x (p + 1) matrix of their products."""
    cols: tuple[str, ...]
    shift: np.ndarray
    a: np.ndarray

    @property
    def n(self) -> float:
        return float(self.a[0, 0])

    @property
    def means(self) -> np.ndarray:
        return self.shift + self.a[0, 1:] / self.n

    @property
    def centred(self) -> np.ndarray:
        """Sums of products of the centred columns."""
        s = self.a[0, 1:]
        return self.a[1:, 1:] - np.outer(s, s) / self.n

    @property
    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products and sums of the columns as they are."""
        s, c = self.a[0, 1:], self.shift
        sums = s + self.n * c
        return self.a[1:, 1:] + np.outer(c, s) + np.outer(s, c) + self.n * np.outer(c, c), sums

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.cols, self.shift, self.a + other.a)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.cols, self.shift, self.a - other.a)


def moments(df: DataFrame, cols: Sequence[str], group: str | None = None) -> dict[int, Moments]:
    """Moments of the rows without NULL or NaN among ``cols``, by the integer column ``group`` (rows with a NULL group are
    left out; without ``group`` one entry 0).  One scan; an empty table gives no entry."""
    cols = tuple(cols)
    shift = _shift(df, cols)

    def products(x: np.ndarray) -> list[np.ndarray]:
        x = x[~np.isnan(x).any(axis=1)] - shift
        z = np.column_stack([np.ones(len(x)), x])
        return [z.T @ z]

    size = len(cols) + 1
    return {g: Moments(cols, shift, m[0]) for g, m in _matrices(_cells(df, cols, group, products), {0: (size, size)}).items()}


def products_of(df: DataFrame, cols: Sequence[str], design) -> np.ndarray:
    """Sum over rows of z'z for the matrix z = ``design(x)`` that a task makes of its rows (x: rows x columns)."""
    found = list(_cells(df, cols, None, lambda x: [(lambda z: z.T @ z)(design(x))]).toArrow().to_pylist())
    size = 1 + max((r["i"] for r in found), default=-1)
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return out


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlation of each pair over the rows that have both; NaN without variance or with fewer than two such rows."""
    shift = _shift(df, cols)
    p = len(cols)

    def products(x: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(x)
        x, m = np.where(there, x - shift, 0.0), there.astype(float)
        return [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]

    found = _matrices(_cells(df, cols, None, products), {k: (p, p) for k in range(4)})
    if not found:
        return np.where(np.eye(p) == 1, 1.0, np.nan)
    n, s, q, g = found[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = g - s * s.T / n
        var = q - s * s / n
        var = np.where(var > 1e-14 * q, var, 0.0)
        r = cov / np.sqrt(var * var.T)
    r = np.where((n >= 2) & np.isfinite(r), r, np.nan)
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1.0, 1.0)


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Mean of every column's values other than NULL (None where it has none) from one scan; NaN counts, as in ``avg``."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(cols)), np.zeros(len(cols), np.int64)
        for b in batches:
            for i, c in enumerate(b.columns):
                x = c.drop_null().to_numpy()
                total[i] += x.sum()
                n[i] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols), dtype=np.int32)), pa.array(total), pa.array(n)], names=["i", "s", "n"])

    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    rows = src.mapInArrow(run, "i int, s double, n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    found = {r["i"]: r["s"] / r["n"] for r in rows if r["n"]}
    return {c: found.get(i) for i, c in enumerate(cols)}
