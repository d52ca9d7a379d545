"""Forests and boosted trees of many folds in the same scans.

A stack fits every family once for each fold left out and once on all rows.
With one MLlib fit each, the rows are read and put into bins for every fit, and
every level of every tree of every fit is a job of its own.  Here the rows are
put into bins once and a scan serves one level of the trees of *all* folds: a
boosted tree ensemble takes ``trees * depth`` scans and a forest ``depth``,
whatever the number of folds.

The trees are those of MLlib's regressors:

* a feature has at most ``BINS`` bins.  Their limits are MLlib's: midpoints of
  neighbouring values, of equal shares of a hash-ordered sample of ``SAMPLE`` rows
  of the fold's own training rows (all rows where there are fewer);
* a split has the largest fall of variance (the first of equals, by feature and
  limit) of those that leave ``min_n`` rows on both sides; values up to the limit
  go left, NULL and NaN go right;
* forest: Poisson(1) weight of a row and tree from a hash, a third of the
  features (rounded up) drawn for each node, mean of the trees;
* boosting: squared error, the first tree counts in full, a later one is fitted
  to twice the residual and counts ``learn_rate`` times.

A task returns its sums by (node, feature, bin); they are added up and searched for
the best split by a group for each tree, so that the driver gets splits only.  Memory
of a task is that of the sums of one level, independent of the rows.

Rows with a NULL label are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.ml.models import _poisson_weights
from sidelines.session import cut_lineage

__all__ = ["Trees", "forest_folds", "gbt_folds", "limits"]

#: Bins of a feature and rows that set their limits (MLlib's numbers).
BINS, SAMPLE = 32, 10_000
#: Rows a task works on at a time.
CHUNK = 1 << 15


def limits(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Limits between the bins of a feature, from a sample of its values."""
    value, count = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(value) <= bins:
        return (value[:-1] + value[1:]) / 2
    stride = count.sum() / bins
    found, target, seen = [], stride, np.cumsum(count)
    for i in range(1, len(value)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            found.append((value[i - 1] + value[i]) / 2)
            target += stride
    return np.array(found)


@dataclass(frozen=True)
class Trees:
    """Full trees of one depth: ``feature`` and ``limit`` of the inner nodes (heap order), ``value`` of the leaves."""
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    base: float

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Predictions of a matrix of the features."""
        out = np.full(len(x), self.base)
        start, flat = np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
        for feature, limit, value, weight in zip(self.feature, self.limit, self.value, self.weight):
            out += weight * value[_walk(flat, start, feature, limit, len(feature).bit_length())]
        return out


def _walk(flat: np.ndarray, start: np.ndarray, feature: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
    """Place within its level of the node that each row (from ``start`` in ``flat``) is in after ``levels`` splits."""
    node = np.zeros(len(start), np.int64)
    for level in range(levels):
        at = node + ((1 << level) - 1)
        node = 2 * node + ~(flat.take(start + feature.take(at)) <= limit.take(at))
    return node


def _codes(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """What :func:`_walk` gives for places in the grid, from whole columns: a comparison of each node, then the bits that hold on a row's path."""
    def bits(node: int, left: int) -> list[np.ndarray]:
        right = columns[feature[node]] > np.uint16(cut[node]) if cut[node] >= 0 else np.ones(columns.shape[1], bool)
        if left == 1:
            return [right]
        return [right, *[a ^ (right & (a ^ b)) for a, b in zip(bits(2 * node + 1, left - 1), bits(2 * node + 2, left - 1))]]

    out = np.zeros(columns.shape[1], np.uint16 if levels > 8 else np.uint8)
    for b in bits(0, levels) if levels else ():
        out = (out << 1) | b
    return out


class _Growing:
    """The trees of one fold left out while they grow; ``cut``: place of a limit in the joint grid of all folds, -1 where nothing is split."""

    def __init__(self, trees: int, depth: int):
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int64)
        self.cut = np.full_like(self.feature, -1)
        self.value = np.zeros((trees, (2 << depth) - 1))                 # of all nodes, the leaves last
        self.alive = np.zeros((trees, (1 << depth) - 1), bool)
        self.alive[:, 0] = True

    def settle(self, tree: int, node: int, best: dict, feature: int, cut: int) -> None:
        if node == 0:
            self.value[tree] = best["s"] / best["n"] if best["n"] else 0.0
        if not best["split"]:
            return                                                       # what lies below has the value of the node
        self.feature[tree, node], self.cut[tree, node] = feature, cut
        for child, s, n in ((2 * node + 1, best["ls"], best["ln"]), (2 * node + 2, best["s"] - best["ls"], best["n"] - best["ln"])):
            below = [child]
            while below[0] < self.value.shape[1]:
                self.value[tree, below] = s / n
                below = [2 * b + k for b in below for k in (1, 2)]
            if child < self.alive.shape[1]:
                self.alive[tree, child] = True


_BEST = "g int, m int, k int, b int, split boolean, n double, s double, ln double, ls double"
_SUMS = pa.schema([("g", pa.int32()), ("h", pa.binary())])


def _best(key, table: pa.Table, places: int, min_n: int) -> pa.Table:
    """Best split of every node from the sums of all tasks."""
    h = np.zeros(len(table.column("h")[0].as_py()) // 8)
    for part in table.column("h"):
        h += np.frombuffer(part.as_buffer(), float)
    h = h.reshape(2, -1, places, BINS)
    left = h.cumsum(axis=3)
    n, s = left[0, :, 0, -1], left[1, :, 0, -1]
    ln, ls = left[0, ..., :-1], left[1, ..., :-1]
    rn, rs = n[:, None, None] - ln, s[:, None, None] - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(n > 0, s * s / n, 0.0)
        gain = ls * ls / ln + rs * rs / rn - whole[:, None, None]
    least = max(min_n, 1)
    gain = np.where((ln >= least) & (rn >= least), gain, -np.inf).reshape(len(n), -1)
    row, most = np.arange(len(n)), gain.max(1)
    at = (gain >= (most - 1e-10 * np.abs(np.where(np.isfinite(most), most, 0.0)))[:, None]).argmax(1)     # the order of sums decides no tie
    k, b = np.divmod(at, BINS - 1)
    return pa.table({"g": pa.array(np.full(len(n), key[0].as_py(), np.int32)), "m": pa.array(row.astype(np.int32)), "k": pa.array(k.astype(np.int32)),
                     "b": pa.array(b.astype(np.int32)), "split": pa.array(gain[row, at] > 1e-12 * whole), "n": pa.array(n), "s": pa.array(s),
                     "ln": pa.array(ln[row, k, b]), "ls": pa.array(ls[row, k, b])})


@dataclass
class _Binned:
    """Rows as places in the joint grid of all folds' limits: ``table`` (x, y, fold, rid)."""
    table: DataFrame | None
    left_out: list[int | None]
    limits: list[list[np.ndarray]]       # by fold left out and feature
    grid: list[np.ndarray]               # by feature
    base: float
    seed: int

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold_col: str, left_out: Sequence[int | None], seed: int) -> _Binned:
        p = len(features)
        nan = F.lit(float("nan"))
        rows = df.where(F.col(label).isNotNull()).select(
            F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in features]).alias("x"), F.col(label).cast("double").alias("y"),
            F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)).alias("fold"), F.xxhash64(*key).alias("rid"))
        few = rows.orderBy(F.xxhash64("rid", F.lit(seed)), "rid", "x").limit(2 * SAMPLE).toArrow().combine_chunks()
        if not few.num_rows:
            raise ValueError("no rows")
        x = few.column("x").combine_chunks().flatten().to_numpy().reshape(-1, p)
        fold = few.column("fold").to_numpy()
        found = [[limits(c) for c in x[fold != out][:SAMPLE].T] for out in (-2 if f is None else f for f in left_out)]
        grid = [np.unique(np.concatenate([one[j] for one in found])) for j in range(p)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                places = np.column_stack([np.searchsorted(g, x[:, j]) for j, g in enumerate(grid)]).astype(np.uint16)
                cut = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (2 * p))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, cut, pa.py_buffer(places)]), *b.columns[1:]], names=b.schema.names)

        table = cut_lineage(rows.mapInArrow(run, "x binary, y double, fold int, rid bigint"))
        return cls(table, list(left_out), found, grid, float(few.column("y").to_numpy().mean()), seed)

    def lookups(self) -> list[np.ndarray]:
        """By fold left out: its bin of every place of the grid, a row for each feature."""
        width = 1 + max(len(g) for g in self.grid)
        out = []
        for mine in self.limits:
            out.append(np.zeros((len(self.grid), width), np.int64))
            for j, g in enumerate(self.grid):
                out[-1][j, :len(g) + 1] = np.append(np.searchsorted(mine[j], g), len(mine[j]))
        return out

    def level(self, fn, places: int, min_n: int) -> list[dict]:
        """Best splits from the sums ``fn(x, y, fold, rid)`` gives as (g, sums) for the rows of a chunk."""
        p, base = len(self.grid), self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}

            def flush(held: list[pa.RecordBatch]) -> None:
                t = pa.Table.from_batches(held).combine_chunks()
                c = t.column("x").combine_chunks()
                x = np.frombuffer(c.buffers()[2], np.uint16, len(c) * p, c.offset * 2 * p).reshape(-1, p)
                for g, h in fn(x, t.column("y").to_numpy() - base, t.column("fold").to_numpy(), t.column("rid").to_numpy()):
                    if g in sums:
                        sums[g] += h
                    else:
                        sums[g] = h

            held: list[pa.RecordBatch] = []
            for b in batches:
                if b.num_rows:
                    held.append(b)
                if sum(h.num_rows for h in held) >= CHUNK:
                    flush(held)
                    held = []
            if held:
                flush(held)
            for g, h in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([h.tobytes()], pa.binary())], schema=_SUMS)

        def best(key, table):
            return _best(key, table, places, min_n)

        return self.table.mapInArrow(run, "g int, h binary").groupBy("g").applyInArrow(best, _BEST).collect()

    def finish(self, grown: _Growing, weight: np.ndarray) -> Trees:
        limit = np.full(grown.cut.shape, np.inf)
        for t, node in zip(*np.nonzero(grown.cut >= 0)):
            limit[t, node] = self.grid[grown.feature[t, node]][grown.cut[t, node]]
        return Trees(grown.feature, limit, grown.value[:, grown.cut.shape[1]:], weight, self.base)


def _nodes(alive: np.ndarray, level: int) -> np.ndarray:
    """Number among the living nodes of each place of a level (-1: none)."""
    on = alive[(1 << level) - 1:(2 << level) - 1]
    return np.where(on, np.cumsum(on) - 1, -1)


def _sums(flat: np.ndarray, start: np.ndarray, m: np.ndarray, nodes: int, drawn: np.ndarray, lookup: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[weights and weighted labels] by node, drawn feature and bin, flat; ``drawn``: features of each node."""
    places = drawn.shape[1]
    feature = drawn[m] if len(drawn) > 1 else drawn
    at = lookup.ravel().take(feature * lookup.shape[1] + flat.take(start[:, None] + feature))
    at += (m * (places * BINS))[:, None] + np.arange(places) * BINS
    at, size = at.ravel(), nodes * places * BINS
    return np.concatenate([np.bincount(at, np.repeat(v, places), size) for v in (w, w * y)])


def _sums_of_columns(columns: np.ndarray, m: np.ndarray, nodes: int, lookup: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[rows and labels] by node, feature and bin, flat; a row of node ``nodes`` does not count."""
    n, s = np.zeros((2, nodes, len(columns), BINS))
    at, start = np.empty(len(m), np.int64), m * BINS
    for j, column in enumerate(columns):
        np.take(lookup[j], column, out=at, mode="clip")
        at += start
        n[:, j] = np.bincount(at, None, (nodes + 1) * BINS)[:nodes * BINS].reshape(nodes, BINS)
        s[:, j] = np.bincount(at, y, (nodes + 1) * BINS)[:nodes * BINS].reshape(nodes, BINS)
    return np.concatenate([n.ravel(), s.ravel()])


def _boosted(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the trees' values; as many trees as fit into 12 bits are looked up together."""
    out, some = np.zeros(columns.shape[1]), max(12 // depth, 1)
    for a in range(0, len(value), some):
        code, table = np.zeros(columns.shape[1], np.uint16), np.zeros(1)
        for t in range(a, min(a + some, len(value))):
            code = (code << depth) | _codes(columns, feature[t], cut[t], depth)
            table = (table[:, None] + value[t]).ravel()
        out += table.take(code)
    return out


def _settle(binned: _Binned, grown: list[_Growing], found: list, level: int, drawn: dict, trees: int) -> None:
    for r in found:
        f, t = divmod(r["g"], trees)
        node = (1 << level) - 1 + int(np.flatnonzero(_nodes(grown[f].alive[t], level) == r["m"])[0])
        feature = int(drawn[f, t][r["m"] if len(drawn[f, t]) > 1 else 0][r["k"]])
        cut = int(np.searchsorted(binned.grid[feature], binned.limits[f][feature][r["b"]])) if r["split"] else -1
        grown[f].settle(t, node, r.asDict(), feature, cut)


def forest_folds(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold_col: str, left_out: Sequence[int | None],
                 trees: int = 200, depth: int = 5, min_n: int = 5, mtry: int | None = None, seed: int = 42) -> list[Trees]:
    """A forest without each fold of ``left_out`` (None: on all rows), a level of all of them in a scan.

    ``key`` names a row, for its weights; ``mtry``: features drawn for a node, a third of them if None."""
    binned = _Binned.of(df, features, label, key, fold_col, left_out, seed)
    p, lookups = len(binned.grid), binned.lookups()
    places = math.ceil(p / 3) if mtry is None else mtry
    grown = [_Growing(trees, depth) for _ in left_out]
    for level in range(depth):
        drawn = {}
        for f, g in enumerate(grown):
            for t in range(trees):
                at = np.flatnonzero(g.alive[t, (1 << level) - 1:(2 << level) - 1])
                if len(at):
                    drawn[f, t] = np.array([np.sort(np.random.default_rng([seed, f, t, level, int(a)]).choice(p, places, replace=False)) for a in at])
        if not drawn:
            break
        state = [(g.feature, g.cut, [_nodes(a, level) for a in g.alive]) for g in grown]

        def fn(x, y, fold, rid, state=state, drawn=drawn, level=level):
            weights = _poisson_weights(rid, trees, seed) if trees > 1 else np.ones((len(y), 1))
            flat, columns = x.ravel(), np.ascontiguousarray(x.T)
            for f, out in enumerate(left_out):
                feature, cut, nodes = state[f]
                use = np.ones(len(y), bool) if out is None else fold != out
                for t in range(trees):
                    if (f, t) not in drawn:
                        continue
                    m = nodes[t].take(_codes(columns, feature[t], cut[t], level))
                    r = np.flatnonzero(use & (weights[:, t] > 0) & (m >= 0))
                    if len(r):
                        yield f * trees + t, _sums(flat, r * p, m[r], len(drawn[f, t]), drawn[f, t], lookups[f], weights[r, t], y[r])

        _settle(binned, grown, binned.level(fn, places, min_n), level, drawn, trees)
    return [binned.finish(g, np.full(trees, 1.0 / trees)) for g in grown]


def gbt_folds(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold_col: str, left_out: Sequence[int | None],
              trees: int = 100, depth: int = 4, min_n: int = 1, learn_rate: float = 0.1, seed: int = 42) -> list[Trees]:
    """Boosted trees without each fold of ``left_out`` (None: on all rows), a level of all of them in a scan."""
    binned = _Binned.of(df, features, label, key, fold_col, left_out, seed)
    p, lookups = len(binned.grid), binned.lookups()
    grown = [_Growing(trees, depth) for _ in left_out]
    weight = np.array([1.0, *[learn_rate] * (trees - 1)])
    every = np.arange(p)[None, :]
    for t in range(trees):
        for level in range(depth):
            state = [(g.feature[:t + 1], g.cut[:t + 1], weight[:t, None] * g.value[:t, g.cut.shape[1]:], _nodes(g.alive[t], level)) for g in grown]
            if all((s[3] < 0).all() for s in state):
                break

            def fn(x, y, fold, rid, state=state, level=level, t=t):
                columns = np.ascontiguousarray(x.T)
                for f, out in enumerate(left_out):
                    feature, cut, value, nodes = state[f]
                    living = int(nodes.max()) + 1
                    if not living:
                        continue
                    m = np.where(nodes < 0, living, nodes).take(_codes(columns, feature[t], cut[t], level))
                    if out is not None:
                        m[fold == out] = living
                    to = 2.0 * (y - _boosted(columns, feature, cut, value, depth)) if t else y
                    yield f * trees + t, _sums_of_columns(columns, m, living, lookups[f], to)

            _settle(binned, grown, binned.level(fn, p, min_n), level, {(f, t): every for f in range(len(grown))}, trees)
    return [binned.finish(g, weight) for g in grown]
