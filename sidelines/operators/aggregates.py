"""Aggregations.

All grouped aggregates are algebraic (partial aggregation map-side) except the
exact quantiles, which have their own skew-safe operator ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_, safe_corr

__all__ = ["summarise", "distinct_keys", "frequency", "two_level", "with_scalar", "scalar",
           "corr_pairwise", "null_profile", "median", "iqr", "quantiles", "hexbin",
           "histogram", "clip"]


def summarise(df: DataFrame, keys: Sequence[str], **exprs: Column) -> DataFrame:
    """``groupBy(keys).agg`` with every output aliased."""
    aggs = [e.alias(k) for k, e in exprs.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct key list (aggregated map-side)."""
    return df.select(*keys).distinct()


def frequency(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """A2: row count per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def two_level(df: DataFrame, k1: Sequence[str], agg1: Mapping[str, Column],
              k2: Sequence[str], agg2: Mapping[str, Column]) -> DataFrame:
    """Aggregate to ``k1`` (e.g. entity-season), then to ``k2`` (season)."""
    mid = summarise(df, k1, **agg1)
    return summarise(mid, k2, **agg2)


def scalar(agg_df: DataFrame) -> Column:
    """A one-row, one-column aggregate used as a constant.

    Planned as a scalar subquery: evaluated once, shipped as a literal.  No
    driver round trip and no cross join."""
    return agg_df.scalar()


def with_scalar(df: DataFrame, agg_df: DataFrame) -> DataFrame:
    """Append every column of a one-row aggregate frame as constants, from one struct-valued subquery."""
    row = agg_df.select(F.struct(*agg_df.columns)).scalar()
    return df.withColumns({c: row[c] for c in agg_df.columns})


def corr_pairwise(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), name: str = "corr") -> DataFrame:
    """Pearson correlation over pairwise-complete rows."""
    return summarise(df, keys, **{name: safe_corr(a, b)})


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row with the NULL count of every column (single pass)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def median(c) -> Column:
    """A8 for groups of bounded size: exact (R type 7) median."""
    return F.percentile(col_(c), 0.5)


def iqr(c) -> Column:
    """A9 for groups of bounded size: type-7 interquartile range."""
    return F.percentile(col_(c), 0.75) - F.percentile(col_(c), 0.25)


def quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Mapping[str, float],
              buckets: int = 256, accuracy: int = 10000) -> DataFrame:
    """Exact type-7 quantiles per group, safe for a group holding a large
    share of all rows.

    1. rows are pre-aggregated to (group, value, count) map-side;
    2. approximate split points per group (mergeable sketch) cut each group
       into ``buckets`` value ranges, so no task ever holds a whole group;
    3. bucket totals (groups x buckets rows) give each bucket its rank offset;
    4. running counts inside a bucket locate the ranks floor/ceil((n-1)p);
    5. only the <= 2 rows per (group, prob) that hold those ranks are
       aggregated to interpolate.
    Result: ``keys + list(probs)`` with NULL for all-NULL groups.
    """
    keys = list(keys)
    v = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    splits = v.groupBy(*keys).agg(
        F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], accuracy).alias("_s"),
        F.sum("_c").alias("_n"))
    if keys:
        vb = v.join(splits, keys, "left")
    else:   # one row: attach as a scalar subquery, not a cross join
        one = splits.select(F.struct("_s", "_n").alias("r")).scalar()
        vb = v.withColumns({"_s": one["_s"], "_n": one["_n"]})
    # bucket = number of split points strictly below the value
    vb = vb.withColumn("_b", F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s")
    kb = keys + ["_b"]
    tot = vb.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bc").over(
        wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wl = Window.partitionBy(*kb).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vr = vb.drop("_n").withColumn("_cum", F.sum("_c").over(wl)).join(tot.drop("_bc"), kb)
    # 0-based rank interval held by this value: [start, end]
    vr = vr.withColumn("_end", F.col("_off") + F.col("_cum") - 1) \
           .withColumn("_start", F.col("_end") - F.col("_c") + 1)
    outs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        vr = vr.withColumn(f"_lo_{name}", F.when((F.col("_start") <= lo) & (lo <= F.col("_end")), F.col("_v"))) \
               .withColumn(f"_hi_{name}", F.when((F.col("_start") <= hi) & (hi <= F.col("_end")), F.col("_v"))) \
               .withColumn(f"_f_{name}", h - lo)
        outs.append(name)
    conds = F.lit(False)
    for name in outs:
        conds = conds | F.col(f"_lo_{name}").isNotNull() | F.col(f"_hi_{name}").isNotNull()
    hits = vr.where(conds)
    aggs = []
    for name in outs:
        lo_v, hi_v, fr = F.max(f"_lo_{name}"), F.max(f"_hi_{name}"), F.max(f"_f_{name}")
        aggs.append((lo_v + fr * (hi_v - lo_v)).alias(name))
    res = hits.groupBy(*keys).agg(*aggs) if keys else hits.agg(*aggs)
    return res


def clip(df: DataFrame, **limits) -> DataFrame:
    """Drop rows outside axis limits, e.g. ``clip(df, x=(0, 10))``."""
    cond = F.lit(True)
    for c, (lo, hi) in limits.items():
        cond = cond & F.col(c).between(lo, hi)
    return df.where(cond)


def hexbin(df: DataFrame, x: str, y: str, binwidth: tuple[float, float],
           origin: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ()) -> DataFrame:
    """Counts per hexagonal cell.

    Two offset rectangular lattices (A at integer, B at half-integer
    coordinates in units of ``binwidth``); each point goes to the nearer
    centre under the hexagonal metric du^2 + 3 dv^2, ties to lattice A.
    Returns ``keys + (hex_x, hex_y, n)`` with the cell centre coordinates.
    """
    bx, by = binwidth
    u = (F.col(x) - F.lit(origin[0])) / F.lit(bx)
    v = (F.col(y) - F.lit(origin[1])) / F.lit(by)
    au, av = F.round(u, 0), F.round(v, 0)
    bu, bv = F.floor(u) + 0.5, F.floor(v) + 0.5
    da = (u - au) * (u - au) + 3 * (v - av) * (v - av)
    db = (u - bu) * (u - bu) + 3 * (v - bv) * (v - bv)
    cu = F.when(da <= db, au).otherwise(bu)
    cv = F.when(da <= db, av).otherwise(bv)
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, (cu * bx + origin[0]).alias("hex_x"), (cv * by + origin[1]).alias("hex_y"))
    return cells.groupBy(*keys, "hex_x", "hex_y").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x: str, bins: int, lim: tuple[float, float],
              keys: Sequence[str] = ()) -> DataFrame:
    """A18 (+A19): equal-width bins over ``lim``; values outside are dropped,
    the upper limit falls in the last bin.  Returns (bin, bin_lo, bin_hi, n)."""
    lo, hi = float(lim[0]), float(lim[1])
    w = (hi - lo) / bins
    b = F.least(F.floor((F.col(x) - lo) / w), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(x).between(lo, hi)).select(*keys, b.alias("bin"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.lit(lo) + F.col("bin") * w)
            .withColumn("bin_hi", F.lit(lo) + (F.col("bin") + 1) * w))
