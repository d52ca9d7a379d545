"""Embedding whitening with an exact polarisation covariance.

Entries become integers, ``floor(1024 c) + 100000``.  Every sum below is an
integer and is added up exactly, so no order of tasks and no offset of the data
changes the covariance:

1. a scan sums each dimension: ``S``;
2. a scan centres each vector on the integer next to its dimension's mean and
   sums the squares of every dimension and of every sum of two dimensions,
   ``sum (y_i + y_j)^2``; 32-bit limbs of the sums travel, one row for each pair
   from each task, combined map-side;
3. the driver, which holds d x d numbers, forms exact variances
   ``n Q - s^2`` (what is left of the centring, ``s = sum y``, is subtracted
   exactly) and takes each covariance from the polarisation identity
   ``2 cov(i, j) = var(i + j) - var(i) - var(j)``; each entry is rounded once,
   and ``eigh`` gives the components;
4. a scan projects the centred vectors, and a last one measures the covariance
   of what comes out.

Components are unit eigenvectors by falling eigenvalue; the entry of largest
size is positive, so all rows and runs agree on the sign.

Defined results: a vector that is NULL, or has a NULL or non-finite entry, is
dropped, and so is one whose length is not the most frequent one (of equally
frequent ones the greatest; empty vectors count as NULL).  Entries beyond
+-2^42 count as that bound.  Repeated rows and ids each count; a NULL id stays.
Without any variance along a component (equal vectors, fewer vectors than
components) ``whitened`` is NULL and ``explained`` 0, and ``identity_error``
covers the other components (0 if there are none).  An empty table gives no
rows; further columns are ignored.  ``deviation`` is a decimal; the query's
long is NULL where the number does not fit (beyond some million rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import table

SCALE, SHIFT, REACH = 1024.0, 100000, 2.0 ** 52
LIMB, LIMBS = 32, 4
#: Numbers of a temporary array in a task.
CELLS = 1 << 20


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): integer vectors of the rows that remain, of any length."""
    v = F.transform(df[vec_col], lambda c: c.cast("double"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(REACH)), F.lit(-REACH))) + F.lit(SHIFT).cast("bigint"))
    return (df.select(df[id_col].cast("bigint").alias("id"), v.alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("id", x.alias("x")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _square_sums(y: np.ndarray) -> list[np.ndarray]:
    """For each i: exact sums of y_i^2 and of (y_i + y_j)^2 for j > i, as integers of any size."""
    n, d = y.shape
    most = int(np.abs(y).max(initial=0))
    if most < 1 << 30:
        step = max(1, min(n, CELLS // d, ((1 << 62) - 1) // max(4 * most * most, 1)))
        parts = [y[a:a + step] for a in range(0, n, step)]
    else:
        parts = [y.astype(object)]
    out = []
    for i in range(d):
        total = np.zeros(d - i, object if len(parts) > 1 or most >= 1 << 30 else np.int64)
        for p in parts:
            pair = p[:, i:] + p[:, i:i + 1]
            pair[:, 0] = p[:, i]
            total = total + (pair * pair).sum(0)
        out.append(total)
    return out


_PAIR = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(f"l{k}", pa.int64()) for k in range(LIMBS)]])


def pair_sums(x: DataFrame, centre: list[int]) -> DataFrame:
    """(i, j, l0..l3): limbs of sum y_i^2 (i = j) and sum (y_i + y_j)^2 (i < j), y = x - centre."""
    d, shift = len(centre), np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = [np.zeros((LIMBS, d - i), np.int64) for i in range(d)]
        some = False
        for b in batches:
            if not b.num_rows:
                continue
            some = True
            y = _matrix(b.column(0), d) - shift
            for a in range(0, len(y), max(1, CELLS // d)):
                for i, total in enumerate(_square_sums(y[a:a + max(1, CELLS // d)])):
                    for k in range(LIMBS):
                        part = total & ((1 << LIMB) - 1) if k < LIMBS - 1 else total
                        limbs[i][k] += part.astype(np.int64)
                        total = total >> LIMB
        for i, l in enumerate(limbs if some else []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, i, np.int32)), pa.array(np.arange(i, d, dtype=np.int32)), *map(pa.array, l)],
                                             schema=_PAIR)

    ddl = ", ".join(["i int", "j int", *[f"l{k} bigint" for k in range(LIMBS)]])
    return x.select("x").mapInArrow(run, ddl).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])


@dataclass(frozen=True)
class Whitener:
    """Exact sums and the eigen decomposition of the covariance."""
    n: int
    sums: tuple[int, ...]           # S, by dimension
    covariance: np.ndarray
    values: np.ndarray              # falling
    components: np.ndarray          # unit columns, in the order of values

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > self.values.sum() * len(self.values) * 2.0 ** -50


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance, divisor n, from the centred sums ``rest`` and the sums of squares; every entry exact before its one rounding."""
    d = len(rest)
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]                   # n^2 var(i)
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / n ** 2
        for j in range(i + 1, d):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2                  # n^2 var(i + j)
            v[i, j] = v[j, i] = (both - own[i] - own[j]) / (2 * n ** 2)
    return v


def fit(vectors: DataFrame) -> Whitener | None:
    """Whitener of all rows (id, x) of one length; None without rows."""
    half = 1 << 26
    cell = vectors.select(F.posexplode("x").alias("i", "x"))
    sums = (cell.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("x", 26)).alias("high"),
                                  F.sum(F.col("x").bitwiseAND(F.lit(half - 1).cast("bigint"))).alias("low")).orderBy("i").collect())
    if not sums:
        return None
    n, s = sums[0]["n"], tuple(r["high"] * half + r["low"] for r in sums)
    centre = [(2 * t + n) // (2 * n) for t in s]
    squares = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in pair_sums(vectors, centre).collect()}
    v = covariance(n, [t - n * c for t, c in zip(s, centre)], squares)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1].copy(), components[:, ::-1].copy()
    components *= np.sign(components[np.abs(components).argmax(0), np.arange(len(s))])
    return Whitener(n, s, v, values, components)


def _exact_deviation(z: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n y - rest)^2 of each row."""
    most = n * int(np.abs(z).max(initial=0)) + int(max(map(abs, rest.tolist()), default=0))
    if z.shape[1] * most * most < 1 << 63:
        dev = n * z - rest
        return pa.array((dev * dev).sum(1)).cast(pa.decimal128(38, 0))
    dev = n * z.astype(object) - rest.astype(object)
    return pa.array([Decimal(int(t)) for t in (dev * dev).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, model: Whitener, k: int = 8) -> DataFrame:
    """(id, deviation, whitened): the exact squared distance n x - S and the first ``k`` whitened coordinates."""
    k = min(k, len(model.sums))
    n, d = model.n, len(model.sums)
    centre = np.array(model.centre, np.int64)
    rest = np.array([t - n * c for t, c in zip(model.sums, model.centre)], np.int64)
    root = np.where(model.has_variance, np.sqrt(np.maximum(model.values, 0.0)), np.nan)[:k]
    w = model.components[:, :k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _matrix(b.column(1), d) - centre
            out = ((y - rest / n) @ w) / root
            coords = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel(), from_pandas=True), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), _exact_deviation(y, n, rest), coords], names=["id", "deviation", "whitened"])

    return vectors.select("id", "x").mapInArrow(run, "id bigint, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, use: list[int]) -> float:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity, over the components ``use`` (from 0)."""
    if not use:
        return 0.0
    at = {a: F.element_at("whitened", a + 1) for a in use}
    pairs = [(a, b) for a in use for b in use if a <= b]
    r = whitened.agg(F.count(F.lit(1)).alias("n"), *[F.avg(at[a]).alias(f"m{a}") for a in use],
                     *[F.avg(at[a] * at[b]).alias(f"q{a}_{b}") for a, b in pairs]).first()
    if not r["n"]:
        return 0.0
    return max(abs(r[f"q{a}_{b}"] - r[f"m{a}"] * r[f"m{b}"] - (a == b)) for a, b in pairs)


def whitened_embeddings(df: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    x = quantised(df, id_col, vec_col)
    size = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    vectors = x.filter(F.size("x") == size["d"]) if size else x.limit(0)
    model = fit(vectors) if size else None
    if model is None:
        return x.limit(0).select("id", F.lit(1).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                                 *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    k = min(k, size["d"])
    done = whiten(vectors, model, k)
    error = identity_error(done, np.flatnonzero(model.has_variance[:k]).tolist())
    trace = float(np.trace(model.covariance))
    explained = [float(e) / trace if ok else 0.0 for e, ok in zip(model.values[:k], model.has_variance)]
    return (done.select("id", "deviation", F.posexplode("whitened").alias("c", "whitened"))
            .select("id", (F.col("c") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.element_at(F.array(*map(F.lit, explained)), F.col("c") + 1).alias("explained"), F.lit(error).alias("identity_error")))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    """Whitened coordinates of every embedding on the first eight components."""
    out = whitened_embeddings(table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("bigint"))
