"""Segmented scans over raw rows (W3-W10, I9): running aggregates within
groups of any size.

A window over a group sorts and scans it in one task.  Here the rows are dealt
out by ranges of (keys, order) and materialised, so that a large group lies in
many partitions, and each piece of a group in one partition is a *chunk*:

1. every chunk is reduced to the partial states of the scans (one row per chunk);
2. a window over the chunk rows gives each chunk what came before it (or after
   it, for scans from the end): as many rows per group as it has chunks;
3. a window inside each chunk scans its rows, and the carry is combined with
   what it finds.

Any associative aggregate can be scanned: a :class:`Monoid` names its partial
aggregate, the aggregate of partials in order, and how carry and local state
combine.  ``sum``, ``count``, ``min``, ``max``, ``mean``, ``last`` (fill) and
their lagged forms are built from five of them.

Results equal those of the window operators for every group size: NULL keys are
one group, ``order`` must be unique within a group, a lagged scan is NULL on a
group's first row, also for counts (N9), and ``na='poison'`` is NULL after the
first NULL (N7).  Sums of doubles may differ in the last places, as they are
added up by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_
from sidelines.operators.nullsafe import join_on
from sidelines.operators.windows import UP, deal_out

__all__ = ["Monoid", "Scan", "segmented_scan", "scan_fill", "scan_lagged"]


@dataclass(frozen=True)
class Monoid:
    """An associative aggregate.

    ``local(c)``: aggregate of a column's rows in scan order; ``partial(c, place)``: the
    same of a whole chunk, whatever the order it is read in; ``merge(c)``: aggregate of partials
    in scan order; ``combine(carry, state)``: of an earlier and a later state, either NULL if empty."""
    local: Callable[[Column], Column]
    partial: Callable[[Column, Column], Column]
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


def _either(f):
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


SUM = Monoid(F.sum, lambda c, _: F.sum(c), F.sum, _either(lambda a, b: a + b))
COUNT = Monoid(F.count, lambda c, _: F.count(c), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
MAX = Monoid(F.max, lambda c, _: F.max(c), F.max, F.greatest)
MIN = Monoid(F.min, lambda c, _: F.min(c), F.min, F.least)
#: The latest non-NULL value; ``place`` grows in scan order.
LAST = Monoid(lambda c: F.last(c, ignorenulls=True), lambda c, place: F.max_by(c, F.when(c.isNotNull(), place)),
              lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))

_MONOIDS = {"sum": SUM, "count": COUNT, "max": MAX, "min": MIN, "last": LAST}


@dataclass(frozen=True)
class Scan:
    """One running aggregate: ``fn`` (sum, count, min, max, mean, last or a Monoid) of ``col``; ``lagged``: of the rows strictly
    before; ``reverse``: from the end of the group; ``na='poison'``: NULL once a NULL has been met."""
    fn: str | Monoid
    col: str | Column
    lagged: bool = False
    reverse: bool = False
    na: str = "skip"

    def parts(self) -> list[tuple[Monoid, Column]]:
        c = col_(self.col)
        if isinstance(self.fn, Monoid):
            main = [(self.fn, c)]
        elif self.fn == "mean":
            main = [(SUM, c), (COUNT, c)]
        else:
            main = [(_MONOIDS[self.fn], c)]
        if self.lagged:
            main.append((COUNT, F.lit(1)))
        if self.na == "poison":
            main.append((COUNT, F.when(c.isNull(), 1)))
        return main

    def finish(self, states: list[Column]) -> Column:
        states = list(states)
        bad = states.pop() if self.na == "poison" else None
        seen = states.pop() if self.lagged else None
        out = F.try_divide(states[0], states[1]) if self.fn == "mean" else states[0]
        if seen is not None:
            out = F.when(seen > 0, out)
        return out if bad is None else F.when(bad == 0, out)


def segmented_scan(df: DataFrame, keys: Sequence[str], order: Sequence, scans: Mapping[str, Scan]) -> DataFrame:
    """``df`` with one column per scan, computed within ``keys`` in the order ``order``.

    All columns of ``df`` travel: project it first."""
    keys = list(keys)
    rows = deal_out(df, keys, order)
    place, chunk = F.col("_mid"), ["_pid", *keys]
    todo = {}                                               # name of a part -> (monoid, column, reverse, lagged)
    for i, s in enumerate(scans.values()):
        for j, (m, c) in enumerate(s.parts()):
            todo[f"_s{i}_{j}"] = (m, c, s.reverse, s.lagged)
    partial = rows.groupBy(*chunk).agg(*[m.partial(c, -place if rev else place).alias(name) for name, (m, c, rev, _) in todo.items()])

    def window(by: Sequence[str], at: str, reverse: bool, to: int):
        w = Window.partitionBy(*by) if by else Window.partitionBy()
        return w.orderBy(F.col(at).desc() if reverse else F.col(at).asc()).rowsBetween(UP, to)

    carry = partial.select(*chunk, *[m.merge(F.col(name)).over(window(keys, "_pid", rev, -1)).alias(f"{name}c")
                                     for name, (m, _, rev, _) in todo.items()])
    local = rows.withColumns({f"{name}l": m.local(c).over(window(chunk, "_mid", rev, -1 if lagged else 0))
                              for name, (m, c, rev, lagged) in todo.items()})
    both = join_on(local, carry, chunk, "left")
    out = {}
    for i, (name, s) in enumerate(scans.items()):
        out[name] = s.finish([m.combine(F.col(f"_s{i}_{j}c"), F.col(f"_s{i}_{j}l")) for j, (m, _) in enumerate(s.parts())])
    kept = [c for c in df.columns if c not in out]
    return both.select(*kept, *[e.alias(name) for name, e in out.items()])


def scan_lagged(df: DataFrame, keys: Sequence[str], order: Sequence, **scans: tuple) -> DataFrame:
    """W3, W5, W6, W8 on raw rows: ``name=(column, fn)`` or ``(column, fn, na)``, everything strictly before the row."""
    return segmented_scan(df, keys, order, {k: Scan(v[1], v[0], lagged=True, na=(*v, "skip")[2]) for k, v in scans.items()})


def scan_fill(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str], direction: str = "down") -> DataFrame:
    """W9, W10 on raw rows: carry the last non-NULL value down, the next one up, or down and then up."""
    if direction not in ("down", "up", "downup"):
        raise ValueError(direction)
    scans = {}
    for c in cols:
        if direction != "up":
            scans[f"{c}__down"] = Scan("last", c)
        if direction != "down":
            scans[f"{c}__up"] = Scan("last", c, reverse=True)
    out = segmented_scan(df, keys, order, scans)
    filled = {c: F.coalesce(*[F.col(n) for n in (f"{c}__down", f"{c}__up") if n in scans]) for c in cols}
    return out.withColumns(filled).select(*df.columns)
