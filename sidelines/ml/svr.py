"""Support-vector regression with an RBF kernel (M15): the epsilon-insensitive
loss on landmark (Nystrom) features.

The kernel is approximated from a bounded number of landmark rows (a
documented parameter, chosen by a seeded hash): ``z(x) = K(x, L) K(L, L)^(-1/2)``.
In these features the machine is linear,

    1/(2 cost n) |w|^2 + mean max(0, |y - b - w z| - epsilon),

and is fitted by limited-memory BFGS; the corners of the loss are rounded over
``delta``.  An iteration is one scan: every task returns its partial loss and
gradient.  Many machines (settings x folds left out) learn in the same scans, so a
whole search costs as many passes as one fit.  Labels and predictors are
standardised; epsilon is in standard deviations of the label, as is usual.

Rows with a NULL label are left out; NULL predictors count as the mean.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.session import cut_lineage

__all__ = ["SvrModel", "fit_svr", "fit_svr_folds", "svr_folds"]


class _Lbfgs:
    """Limited-memory BFGS that is told values and asked for points, so that many of them can share a scan."""

    def __init__(self, size: int, memory: int = 10):
        self.x, self.f, self.g = np.zeros(size), None, None
        self.pairs: deque = deque(maxlen=memory)
        self.step, self.direction, self.done = 1.0, None, False

    def ask(self) -> np.ndarray:
        return self.x if self.f is None or self.done else self.x + self.step * self.direction

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.done:
            return
        if self.f is not None:
            if f > self.f + 1e-4 * self.step * (self.g @ self.direction):          # too far: go back
                self.step *= 0.5
                self.done = self.step < 1e-12
                return
            s, y = self.step * self.direction, g - self.g
            if s @ y > 1e-14:
                self.pairs.append((s, y))
            self.done = self.f - f < 1e-9 * max(abs(f), 1e-12) and self.step == 1.0
            self.x = self.x + s
        self.f, self.g = f, g
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for a, s, y in reversed(used):
            q += (a - (y @ q) / (s @ y)) * s
        self.direction, self.step = -q, 1.0
        if g @ self.direction >= 0:
            self.direction = -g
            self.pairs.clear()
        if np.abs(g).max() < 1e-9:
            self.done = True


def _kernel(x: np.ndarray, at: np.ndarray, sigma: float) -> np.ndarray:
    d = x @ at.T
    d *= -2.0
    d += (x * x).sum(1)[:, None]
    d += (at * at).sum(1)
    np.maximum(d, 0.0, out=d)
    d *= -sigma
    return np.exp(d, out=d)


def _loss_and_slope(k: np.ndarray, y: np.ndarray, fold: np.ndarray, to: np.ndarray, machines: Sequence[tuple[np.ndarray, int | None]],
                    epsilon: float, delta: float) -> list[np.ndarray]:
    """For each machine (theta, fold left out): loss, rows, rows inside the tube, and the gradient of the loss.

    The kernel values ``k`` meet each machine's weights of the landmarks (``to @ theta``), so that the features
    ``k @ to`` of the rows are never made: two products with a vector a machine instead of one with a matrix."""
    residual = k @ np.column_stack([to @ theta[:-1] for theta, _ in machines])
    residual += np.array([theta[-1] for theta, _ in machines])
    residual -= y[:, None]
    facts = []
    for j, (_, out) in enumerate(machines):
        over = np.abs(residual[:, j]) - epsilon
        use = np.ones(len(y), bool) if out is None else fold != out
        loss = np.where(over <= 0, 0.0, np.where(over < delta, over * over / (2 * delta), over - delta / 2))
        facts.append([loss[use].sum(), use.sum(), (over[use] <= 0).sum()])
        residual[:, j] = np.clip(over / delta, 0.0, 1.0) * np.sign(residual[:, j]) * use
    grad = to.T @ (k.T @ residual)
    return [np.concatenate([facts[j], grad[:, j], [residual[:, j].sum()]]) for j in range(len(machines))]


def _whitened(at: np.ndarray, sigma: float) -> np.ndarray:
    """K(L, L)^(-1/2), without directions of no weight."""
    values, vectors = np.linalg.eigh(_kernel(at, at, sigma))
    keep = values > 1e-8 * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass(frozen=True)
class SvrModel:
    features: tuple[str, ...]
    means: np.ndarray
    stds: np.ndarray
    y_mean: float
    y_std: float
    landmarks: np.ndarray
    sigma: float
    weights: np.ndarray          # of the kernel values
    bias: float
    inside: float                # share of training rows inside the tube
    cost: float
    epsilon: float

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        m = self

        @F.pandas_udf("double")
        def predict(*cols: pd.Series) -> pd.Series:
            return pd.Series(m.of_rows(np.column_stack([c.astype(float).to_numpy() for c in cols])))

        return df.withColumn(out, predict(*[F.col(c) for c in self.features]))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Predictions of a matrix of the features (NaN: the mean)."""
        x = np.where(np.isnan(x), self.means, x)
        k = _kernel((x - self.means) / self.stds, self.landmarks, self.sigma)
        return (k @ self.weights + self.bias) * self.y_std + self.y_mean


_PART = pa.schema([("m", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


@dataclass
class _Data:
    table: DataFrame             # x array<double>, y, fold
    features: tuple[str, ...]
    means: np.ndarray
    stds: np.ndarray
    y_mean: float
    y_std: float
    landmarks: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str, landmarks: int, seed: int, fold_col: str | None) -> _Data:
        features = tuple(features)
        rows = df.where(F.col(label).isNotNull())
        cols = [F.col(c).cast("double") for c in (*features, label)]
        r = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        means = np.array([r[f"m{i}"] or 0.0 for i in range(len(cols))])
        stds = np.array([r[f"s{i}"] or 1.0 for i in range(len(cols))])
        scaled = [(F.coalesce(c, F.lit(float(m))) - float(m)) / float(s) for c, m, s in zip(cols, means, stds)]
        fold = (F.col(fold_col) if fold_col else F.lit(-1)).cast("int")
        table = cut_lineage(rows.select(F.array(*scaled[:-1]).alias("x"), scaled[-1].alias("y"), fold.alias("fold")))
        at = table.select("x").distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(landmarks).toArrow().column("x")
        at = at.combine_chunks().flatten().to_numpy().reshape(-1, len(features))
        return cls(table, features, means[:-1], stds[:-1], float(means[-1]), float(stds[-1]), at)

    def sums(self, fn) -> dict[int, np.ndarray]:
        """Sum over all rows of the vectors ``fn(x, y, fold)`` gives by machine; summed by Spark."""
        return _sums(self.table, len(self.features), fn)


def _sums(table: DataFrame, p: int, fn) -> dict[int, np.ndarray]:
    """Sum over all rows (x of ``p`` entries, y, fold) of the vectors ``fn(x, y, fold)`` gives by machine; summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(-1, p)
                for m, v in fn(x, b.column(1).to_numpy(), b.column(2).to_numpy()):
                    total[m] = total[m] + v if m in total else v
        for m, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), m, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)],
                                             schema=_PART)

    t = table.mapInArrow(run, "m int, j int, v double").groupBy("m", "j").agg(F.sum("v").alias("v")).toArrow()
    m, j, v = (t.column(c).to_numpy() for c in ("m", "j", "v"))
    out = {}
    for one in np.unique(m):
        at = m == one
        out[int(one)] = np.zeros(int(j[at].max()) + 1)
        out[int(one)][j[at]] = v[at]
    return out


def _train(data: _Data, configs: Sequence[tuple[float, float]], left_out: Sequence[int | None], epsilon: float, delta: float, iterations: int):
    """All machines (config, fold left out): (optimiser, sums of the last scan) by (config, fold place)."""
    maps = [_whitened(data.landmarks, sigma) for _, sigma in configs]
    machines = [(c, f) for c in range(len(configs)) for f in range(len(left_out))]
    opt = {i: _Lbfgs(maps[c].shape[1] + 1) for i, (c, _) in enumerate(machines)}
    last: dict[int, np.ndarray] = {}
    at = data.landmarks
    for _ in range(iterations):
        todo = {i: o.ask() for i, o in opt.items() if not o.done}
        if not todo:
            break

        def fn(x, y, fold, todo=todo):
            for c, (_, sigma) in enumerate(configs):
                mine = [(i, left_out[f]) for i, (k, f) in enumerate(machines) if k == c and i in todo]
                if not mine:
                    continue
                found = _loss_and_slope(_kernel(x, at, sigma), y, fold, maps[c], [(todo[i], out) for i, out in mine], epsilon, delta)
                yield from zip((i for i, _ in mine), found)

        last.update(data.sums(fn))
        for i in todo:
            cost, n, theta = configs[machines[i][0]][0], last[i][1], todo[i]
            ridge = np.append(theta[:-1], 0.0) / (cost * n)
            opt[i].tell(last[i][0] / n + 0.5 * (theta[:-1] @ theta[:-1]) / (cost * n), last[i][3:] / n + ridge)
    return machines, maps, opt, last


def fit_svr(df: DataFrame, features: Sequence[str], label: str, cost: float = 1.0, sigma: float | None = None, epsilon: float = 0.1,
            landmarks: int = 64, iterations: int = 60, delta: float = 0.02, seed: int = 42) -> SvrModel:
    """One machine on all rows."""
    data = _Data.of(df, features, label, landmarks, seed, None)
    sigma = 1.0 / len(data.features) if sigma is None else sigma
    _, maps, opt, last = _train(data, [(cost, sigma)], [None], epsilon, delta, iterations)
    theta = opt[0].x
    return SvrModel(data.features, data.means, data.stds, data.y_mean, data.y_std, data.landmarks, sigma, maps[0] @ theta[:-1], float(theta[-1]),
                    float(last[0][2] / last[0][1]) if last else 0.0, cost, epsilon)


def _spread(table: DataFrame, p: int, left_out: Sequence[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and standard deviations of the ``p`` predictors and the label without each fold, from one scan; missing values do not count."""
    shift = table.select("x", "y").first()
    shift = np.nan_to_num(np.array([*shift["x"], shift["y"]]), posinf=0.0, neginf=0.0)

    def fn(x, y, fold):
        z = np.column_stack([x, y]) - shift
        there = ~np.isnan(z)
        z = np.where(there, z, 0.0)
        for f in np.unique(fold):
            mine = fold == f
            yield int(f), np.concatenate([there[mine].sum(0), z[mine].sum(0), (z[mine] ** 2).sum(0)])

    by_fold = {f: v.reshape(3, p + 1) for f, v in _sums(table, p, fn).items()}
    out = []
    for f in left_out:
        n, s, ss = sum((v for g, v in by_fold.items() if f is None or g != f), np.zeros((3, p + 1)))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, s / n, 0.0)
            var = (ss - s * mean) / (n - 1)
        flat = ~(var > 1e-13 * np.maximum(ss, 0.0) / np.maximum(n, 1.0))
        out.append((np.where(n > 0, shift + mean, 0.0), np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))))
    return out


def _landmarks(table: DataFrame, p: int, left_out: Sequence[int | None], most: int, seed: int) -> list[np.ndarray]:
    """The first ``most`` distinct predictors without each fold in the order of a seeded hash.

    Only rows of small hashes are made distinct; the share of hashes grows until every fold has enough or all rows were seen."""
    rows = table.select("x", "fold", F.xxhash64("x", F.lit(seed)).alias("h"))
    n, share = table.count(), 64 * most
    while True:
        whole = share >= n
        part = rows if whole else rows.where(F.col("h") < int(-(2 ** 63) + 2 ** 64 * share // n))
        few = part.groupBy("h", "x").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).orderBy("h", "x").limit(4 * most).toArrow().combine_chunks()
        a, b = few.column("a").to_numpy(), few.column("b").to_numpy()
        there = [np.flatnonzero(~((a == f) & (b == f))) if f is not None else np.arange(len(a)) for f in left_out]
        if all(len(t) >= most for t in there) or whole and len(a) < 4 * most:
            x = few.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            return [x[t[:most]] for t in there]
        if whole:                                  # a fold of nearly all the first rows: look at each fold left out alone
            out = []
            for f in left_out:
                one = (rows if f is None else rows.where(F.col("fold") != f)).groupBy("h", "x").agg(F.min("fold")).orderBy("h", "x").limit(most)
                out.append(one.toArrow().combine_chunks().column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p))
            return out
        share *= 64


def fit_svr_folds(df: DataFrame, features: Sequence[str], label: str, fold_col: str, left_out: Sequence[int | None], cost: float = 1.0,
                  sigma: float | None = None, epsilon: float = 0.1, landmarks: int = 64, iterations: int = 60, delta: float = 0.02,
                  seed: int = 42) -> list[SvrModel]:
    """A machine without each fold of ``left_out`` (None: on all rows), with its own scale and landmarks; all learn in the same scans."""
    features = tuple(features)
    p, nan = len(features), F.lit(float("nan"))
    sigma = 1.0 / p if sigma is None else sigma
    rows = df.where(F.col(label).isNotNull())
    table = cut_lineage(rows.select(F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in features]).alias("x"), F.col(label).cast("double").alias("y"),
                                    F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)).alias("fold")))
    scale = _spread(table, p, left_out)

    def scaled(x, f):
        mean, std = scale[f]
        x = (x - mean[:-1]) / std[:-1]
        x[np.isnan(x)] = 0.0
        return x

    at = [scaled(x, f) for f, x in enumerate(_landmarks(table, p, left_out, landmarks, seed))]
    maps = [_whitened(x, sigma) for x in at]
    opt = [_Lbfgs(m.shape[1] + 1) for m in maps]
    last: dict[int, np.ndarray] = {}
    for _ in range(iterations):
        todo = {f: o.ask() for f, o in enumerate(opt) if not o.done}
        if not todo:
            break

        def fn(x, y, fold, todo=todo):
            for f, theta in todo.items():
                use = fold == fold if left_out[f] is None else fold != left_out[f]
                mean, std = scale[f]
                k = _kernel(scaled(x[use], f), at[f], sigma)
                yield f, _loss_and_slope(k, (y[use] - mean[-1]) / std[-1], fold[use], maps[f], [(theta, None)], epsilon, delta)[0]

        last.update(_sums(table, p, fn))
        for f, theta in todo.items():
            n = last[f][1]
            opt[f].tell(last[f][0] / n + 0.5 * (theta[:-1] @ theta[:-1]) / (cost * n), last[f][3:] / n + np.append(theta[:-1], 0.0) / (cost * n))
    return [SvrModel(features, m[:-1], s[:-1], float(m[-1]), float(s[-1]), at[f], sigma, maps[f] @ opt[f].x[:-1], float(opt[f].x[-1]),
                     float(last[f][2] / last[f][1]), cost, epsilon) for f, (m, s) in enumerate(scale)]


def svr_folds(df: DataFrame, features: Sequence[str], label: str, configs: Sequence[tuple[float, float]], fold_col: str, epsilon: float = 0.1,
              landmarks: int = 64, iterations: int = 40, delta: float = 0.02, seed: int = 42) -> list[list[float]]:
    """Root mean square error on each fold left out, for every (cost, sigma); all machines learn in the same scans."""
    data = _Data.of(df, features, label, landmarks, seed, fold_col)
    folds = [r[0] for r in data.table.select("fold").distinct().orderBy("fold").collect()]
    machines, maps, opt, _ = _train(data, configs, folds, epsilon, delta, iterations)
    theta = {i: o.x for i, o in opt.items()}
    at = data.landmarks

    def errors(x, y, fold):
        for c, (_, sigma) in enumerate(configs):
            near = _kernel(x, at, sigma)
            for i, (k, f) in enumerate(machines):
                if k == c:
                    held = fold == folds[f]
                    e = near[held] @ (maps[c] @ theta[i][:-1]) + theta[i][-1] - y[held]
                    yield i, np.array([(e * e).sum(), held.sum()], float)

    found = data.sums(errors)
    out: list[list[float]] = [[] for _ in configs]
    for i, (c, _) in enumerate(machines):
        out[c].append(float(np.sqrt(found[i][0] / found[i][1])) * data.y_std)
    return out
