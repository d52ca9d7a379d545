"""Window operators.

Every ordered window takes the partition keys ``K`` and an order ``O`` that
must end in a unique tiebreak, so results never depend on physical row order.
Season-to-date frames end one row before the current row (no leakage).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_
from sidelines.operators.nullsafe import join_on
from sidelines.session import cut_lineage

__all__ = ["spec", "with_totals", "season_lag", "lagged_cum", "season_to_date_ratio",
           "fill", "row_index", "last_per_group", "group_id", "deal_out", "global_row_number",
           "fallback_chain", "suppress_small", "qualified_or_group"]

UP, UF = Window.unboundedPreceding, Window.unboundedFollowing


def _order(o) -> Column:
    c = col_(o)
    return c.asc_nulls_last() if isinstance(o, str) else c


def _reversed(o) -> Column:
    """The opposite of :func:`_order` for a column name (NULLs first)."""
    if not isinstance(o, str):
        raise TypeError("filling upwards needs column names as its order")
    return F.col(o).desc_nulls_first()


def spec(keys: Sequence[str], order: Sequence = ()):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return w.orderBy(*[_order(o) for o in order]) if order else w


def with_totals(df: DataFrame, keys: Sequence[str], **exprs: Column) -> DataFrame:
    """Attach group totals to every row (``group_by %>% mutate(sum(x))``).

    Planned as aggregate + join rather than an unordered window: the aggregate
    is combined map-side and the join streams the big side, so a hot key is
    never buffered in one task (AQE splits skewed join partitions).  Rows with
    a NULL key are a group of their own and get its totals."""
    tot = df.groupBy(*keys).agg(*[e.alias(k) for k, e in exprs.items()])
    return join_on(df, tot, list(keys), "left")


def season_lag(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str],
               n: int = 1, prefix: str = "lag_") -> DataFrame:
    """Value ``n`` rows back inside each group."""
    w = spec(keys, order)
    return df.withColumns({f"{prefix}{c}": F.lag(c, n).over(w) for c in cols})


def lagged_cum(c, fn: str, keys: Sequence[str], order: Sequence, na: str = "skip") -> Column:
    """Aggregate of everything strictly before the row.

    ``fn`` in sum|max|min|mean|count.  First row of a group -> NULL, also for
    counts (N9).  ``na='poison'`` makes the result NULL once a NULL has been
    seen in the frame, like ``cumsum``/``cummax`` (N7)."""
    c = col_(c)
    w = spec(keys, order).rowsBetween(UP, -1)
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "count": F.count}[fn](c).over(w)
    seen = F.count(F.lit(1)).over(w)
    out = F.when(seen > 0, agg)
    if na == "poison":
        out = F.when(F.count_if(c.isNull()).over(w) == 0, out)
    return out


def season_to_date_ratio(num, den, keys: Sequence[str], order: Sequence, na: str = "skip") -> Column:
    """``lag(cumsum(num)) / lag(cumsum(den))``; 0/0 -> NULL."""
    return F.try_divide(lagged_cum(num, "sum", keys, order, na),
                        lagged_cum(den, "sum", keys, order, na))


def fill(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str],
         direction: str = "down") -> DataFrame:
    """Carry the last non-NULL value down (then the next one up).

    Upward filling runs down the reversed order: a frame that only grows is
    linear, one that shrinks from the front is aggregated anew for each row."""
    down = spec(keys, order).rowsBetween(UP, 0)
    up = spec(keys, [_reversed(o) for o in order]).rowsBetween(UP, 0)
    out = {}
    for c in cols:
        d = F.last(c, ignorenulls=True).over(down)
        if direction == "down":
            out[c] = d
        elif direction == "downup":
            out[c] = F.coalesce(d, F.last(c, ignorenulls=True).over(up))
        elif direction == "up":
            out[c] = F.last(c, ignorenulls=True).over(up)
        else:
            raise ValueError(direction)
    return df.withColumns(out)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "idx") -> DataFrame:
    """1-based row number inside each group (groups are bounded series)."""
    return df.withColumn(name, F.row_number().over(spec(keys, order)))


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence,
                   size_col: str | None = "n") -> DataFrame:
    """The last row of each group by ``order`` plus the group size.

    ``max_by`` over a struct is algebraic (partial aggregation), so a hot
    group is reduced map-side instead of being sorted in one task."""
    order = [col_(o) for o in order]
    rest = [c for c in df.columns if c not in keys]
    agg = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")]
    if size_col:
        agg.append(F.count(F.lit(1)).alias(size_col))
    out = df.groupBy(*keys).agg(*agg).select(*keys, "_last.*", *([size_col] if size_col else []))
    return out


def deal_out(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows range-partitioned on ``keys + order``, sorted, with the partition's
    number ``_pid`` and ``_mid``, which grows in that order, materialised.

    A range partitioning that is computed twice need not cut at the same
    places, so whatever is counted by partition must come from one and the
    same dealing-out: it is written once (``cut_lineage``)."""
    by = [_order(o) for o in order]
    part = cut_lineage(df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
                       .withColumn("_mid", F.monotonically_increasing_id()))
    return part.withColumn("_pid", F.shiftright("_mid", 33))


def global_row_number(df: DataFrame, order: Sequence, name: str = "rn",
                      keys: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Row number (or dense rank over distinct ``order`` values) by a total
    order, computed without funnelling a group through one task.

    Rows are dealt out by ranges (``deal_out``) and numbered by their place in
    the partition; the counts (partitions x keys rows) give each partition its
    offset.  NULL keys are one group.  ``order`` (names, NULLs last, or sort
    expressions) must be unique within ``keys`` unless ``dense``.
    """
    keys = list(keys)
    src = df.select(*keys, *order).distinct() if dense else df
    part = deal_out(src, keys, order).withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    cnt = part.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_pc"), F.min("_loc").alias("_first"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_pid")
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_pc").over(w.rowsBetween(UP, -1)), F.lit(0)))
    ranked = join_on(part, cnt.select("_pid", *keys, "_off", "_first"), ["_pid", *keys]) \
        .withColumn(name, F.col("_off") + F.col("_loc") - F.col("_first") + 1) \
        .drop("_mid", "_pid", "_loc", "_off", "_first")
    return join_on(df, ranked, [*keys, *order], "left") if dense else ranked


def group_id(df: DataFrame, keys: Sequence[str], name: str = "group_id") -> DataFrame:
    """Dense 1-based id of each key combination in key order
    (``cur_group_id``), computed on the distinct key table."""
    return global_row_number(df, keys, name=name, dense=True)


def fallback_chain(own, n, min_n: int, *fallbacks) -> Column:
    """Own season-to-date value when at least ``min_n`` prior games, else
    the first non-NULL fallback (own last season, then league last season)."""
    n = col_(n)
    small = (n < min_n) | n.isNull()
    return F.when(small, F.coalesce(*[col_(f) for f in fallbacks])).otherwise(col_(own))


def suppress_small(c, n, min_n: int) -> Column:
    """NULL out a value computed from fewer than ``min_n`` games."""
    return F.when(col_(n) >= min_n, col_(c))


def qualified_or_group(own, qualified, group) -> Column:
    """Own value where the sample qualifies, else the group value;
    a NULL flag gives NULL (``ifelse``)."""
    q = col_(qualified)
    return F.when(q, col_(own)).when(~q, col_(group))
