"""Joins (J1-J12).

No join here broadcasts a side whose size is not bounded by construction:
1-row aggregates are scalar subqueries, user patch/alias tables are small
literal tables, everything else (patch and alias tables too) is left to AQE,
which switches to a broadcast join only after measuring the real size at runtime.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators.nullsafe import join_on

__all__ = ["enrich", "densify", "opponent_role", "override", "apply_patches",
           "with_fallback_row", "normalise_codes", "grid", "scenario", "cross_with"]


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(k, k) for k in on]


def enrich(df: DataFrame, dim: DataFrame, on, how: str = "left", null_safe: bool = False) -> DataFrame:
    """Equi-join on same- or differently-named keys.

    ``null_safe`` matches NULL to NULL (N4).  Right-side key columns that
    duplicate left names are dropped."""
    pairs = _pairs(on)
    right = dim
    if not null_safe and all(l == r for l, r in pairs):
        return df.join(right, [l for l, _ in pairs], how)
    ren = {r: f"__r_{r}" for _, r in pairs}
    right = right.withColumnsRenamed(ren)
    cond = reduce(lambda a, b: a & b, [
        (df[l].eqNullSafe(right[ren[r]]) if null_safe else df[l] == right[ren[r]]) for l, r in pairs])
    out = df.join(right, cond, how)
    # keep one copy of each key: the left one, filled from the right on right joins
    fixes = {l: F.coalesce(F.col(l), F.col(ren[r])) for l, r in pairs if l == r} if how in ("right", "full", "outer") else {}
    if fixes:
        out = out.withColumns(fixes)
    drop = [ren[r] for l, r in pairs if l == r] + [ren[r] for l, r in pairs if l != r and r in df.columns]
    out = out.drop(*drop)
    back = {ren[r]: r for l, r in pairs if l != r and r not in df.columns}
    return out.withColumnsRenamed(back) if back else out


def densify(facts: DataFrame, spine: DataFrame, on: Sequence[str],
            zero_cols: Sequence[str] = ()) -> DataFrame:
    """Every spine row survives; fact columns in ``zero_cols`` become 0
    where the spine row had no facts.  Both sides aggregated on ``on`` share
    their hash partitioning, so the join adds no exchange of its own.  NULL
    keys match NULL keys."""
    out = join_on(spine, facts, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero_cols}) if zero_cols else out


def opponent_role(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename so an offence table can be joined as the opponent table."""
    return df.withColumnsRenamed(dict(mapping))


def override(df: DataFrame, patch: DataFrame, on, target: str, source: str,
             when: Column | None = None) -> DataFrame:
    """Fill ``target`` from ``source`` of a left-joined patch table where
    ``target`` is NULL and ``when`` holds; NULL ``when`` leaves it unchanged."""
    j = enrich(df, patch, on, "left")
    cond = F.col(target).isNull() & (when if when is not None else F.lit(True))
    return j.withColumn(target, F.when(cond, F.col(source)).otherwise(F.col(target))).drop(source)


def apply_patches(df: DataFrame, patches: DataFrame, key: str, cols: Mapping[str, str],
                  order_col: str = "patch_no") -> DataFrame:
    """Keyed single-cell fixes ``(key, column, value, patch_no)``.

    The patch table is pivoted to one row per key (the highest ``patch_no``
    wins for a cell) and left-joined; patched cells take the patch value cast
    to the column type, others keep their value.  ``cols`` maps column name
    to Spark type."""
    wide = (patches.groupBy(key).pivot("column", list(cols))
            .agg(F.max_by(F.struct(F.lit(True).alias("set"), F.col("value").alias("value")), order_col)))
    wide = wide.select(key, *[F.col(c).alias(f"__p_{c}") for c in cols])
    j = df.join(wide, key, "left")
    return j.withColumns({
        c: F.when(F.col(f"__p_{c}.set"), F.col(f"__p_{c}.value").cast(t)).otherwise(F.col(c))
        for c, t in cols.items()}).drop(*[f"__p_{c}" for c in cols])


def with_fallback_row(df: DataFrame, dim: DataFrame, on: str, fallback_key: str,
                      cols: Sequence[str], dim_key: str | None = None) -> DataFrame:
    """Left-join ``dim``; entities without a row take the ``fallback_key``
    row's values (e.g. the ``Other`` kicker).  The fallback comes from the
    table passed in, not a constant, since its value differs between saved
    tables (Q16).  The fallback row is one struct-valued scalar subquery, so
    it is computed once and shipped as a literal."""
    dim_key = dim_key or on
    fb = dim.where(F.col(dim_key) == fallback_key).agg(F.struct(*[F.max(c).alias(c) for c in cols])).scalar()
    right = dim.where(F.col(dim_key) != fallback_key).select(
        F.col(dim_key).alias("__k"), *[F.col(c).alias(f"__d_{c}") for c in cols])
    j = df.join(right, df[on] == right["__k"], "left")
    return j.withColumns({c: F.coalesce(F.col(f"__d_{c}"), fb[c]) for c in cols}) \
            .drop("__k", *[f"__d_{c}" for c in cols])


def normalise_codes(df: DataFrame, c: str, alias_df: DataFrame, src: str = "alias",
                    dst: str = "code") -> DataFrame:
    """Map aliases to canonical codes; unknown codes pass through."""
    a = alias_df.select(F.col(src).alias("__a"), F.col(dst).alias("__c"))
    return df.join(a, df[c] == a["__a"], "left") \
             .withColumn(c, F.coalesce(F.col("__c"), F.col(c))).drop("__a", "__c")


def grid(spark: SparkSession, values: Mapping[str, Sequence], index_col: str | None = "grid_index") -> DataFrame:
    """Cross product of value vectors, first column varying slowest.

    Generated from one ``range`` by index arithmetic, so it is produced in
    parallel with no join at all; ``index_col`` keeps the expand order."""
    names = list(values)
    sizes = [len(values[n]) for n in names]
    total = 1
    for s in sizes:
        total *= s
    cols = []
    stride = total
    for n, s in zip(names, sizes):
        stride //= s
        arr = F.array(*[F.lit(v) for v in values[n]])
        cols.append(F.element_at(arr, ((F.col("id") / stride).cast("long") % s + 1).cast("int")).alias(n))
    out = spark.range(total).select(*cols, *( [F.col("id").alias(index_col)] if index_col else []))
    return out


def scenario(spark: SparkSession, base: Mapping[str, object], values: Mapping[str, Sequence],
             index_col: str | None = "grid_index") -> DataFrame:
    """Baseline row minus the varied columns, crossed with the grid.
    The baseline is literal, so it is attached as constant columns."""
    g = grid(spark, values, index_col)
    const = [F.lit(v).alias(k) for k, v in base.items() if k not in values]
    return g.select(*const, *g.columns)


def cross_with(base: DataFrame, grid_df: DataFrame) -> DataFrame:
    """J6 for a baseline held as a one-row DataFrame: it becomes one
    struct-valued scalar subquery (computed once) on the grid rows.  Columns of the
    baseline that the grid varies are dropped, as in the source."""
    keep = [c for c in base.columns if c not in grid_df.columns]
    if not keep:
        return grid_df
    row = base.agg(F.struct(*[F.max(c).alias(c) for c in keep])).scalar()
    return grid_df.select(*[row[c].alias(c) for c in keep], *grid_df.columns)
