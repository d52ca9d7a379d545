"""Column shaping and reshaping."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.functions.nulls import col_
from sidelines.operators.windows import global_row_number
from sidelines.session import cut_lineage

__all__ = ["mutate", "cast_all", "across_numeric", "separate", "mask_between", "append",
           "stack_rows", "pivot_wider", "pivot_longer", "dummies", "design_matrix",
           "levels_by_frequency", "NUMERIC_TYPES"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def mutate(df: DataFrame, **exprs) -> DataFrame:
    """Derived columns in order; later expressions see earlier ones."""
    for k, e in exprs.items():
        df = df.withColumn(k, e(df) if callable(e) and not isinstance(e, Column) else e)
    return df


def cast_all(df: DataFrame, cols: Sequence[str], dtype: str) -> DataFrame:
    """One type change over a list of columns."""
    return df.withColumns({c: F.col(c).cast(dtype) for c in cols})


def across_numeric(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """P5: apply ``fn`` to every numeric column (e.g. rounding)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    return df.withColumns({c: fn(F.col(c)) for c in num})


def separate(df: DataFrame, c: str, into: Sequence[str], sep: str, remove: bool = True) -> DataFrame:
    """Split one text column into several; surplus pieces are dropped,
    missing pieces are NULL.  ``sep`` is a regular expression."""
    parts = F.split(F.col(c), sep)
    out = df.withColumns({n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(into)})
    return out.drop(c) if remove and c not in into else out


def mask_between(c, idx, start: int, end: int) -> Column:
    """NULL where ``start <= idx <= end`` (post-period outcome masked)."""
    return F.when(~col_(idx).between(start, end), col_(c))


def append(*dfs: DataFrame) -> DataFrame:
    """Rows appended by column name; a missing column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def stack_rows(df: DataFrame, cols: Sequence[str], label_col: str = "name",
               value_col: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """Vectors (columns) stacked as rows, one per (id, column)."""
    return df.unpivot(list(ids), list(cols), label_col, value_col)


def pivot_wider(df: DataFrame, id_cols: Sequence[str], names_from: str, names: Sequence,
                values_from: str | Sequence[str], prefix: str = "", agg: str = "first") -> DataFrame:
    """Long -> wide with an explicit level list (no extra pass to
    discover levels).  Several value columns are named ``{value}_{level}``."""
    vals = [values_from] if isinstance(values_from, str) else list(values_from)
    fn = {"first": lambda c: F.first(c, ignorenulls=True), "sum": F.sum, "max": F.max,
          "mean": F.avg}[agg]
    g = df.groupBy(*id_cols).pivot(names_from, list(names))
    if len(vals) == 1:
        out = g.agg(fn(vals[0]))
        return out.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names}) if prefix else out
    out = g.agg(*[fn(v).alias(v) for v in vals])
    ren = {f"{n}_{v}": f"{prefix}{v}_{n}" for n in names for v in vals}
    return out.withColumnsRenamed(ren)


def pivot_longer(df: DataFrame, cols: Sequence[str], names_to: str = "name",
                 values_to: str = "value", ids: Sequence[str] | None = None) -> DataFrame:
    """Wide -> long."""
    ids = [c for c in df.columns if c not in cols] if ids is None else list(ids)
    return df.unpivot(ids, list(cols), names_to, values_to)


def levels_by_frequency(df: DataFrame, c: str, max_levels: int = 1000) -> list:
    """Distinct non-NULL levels, most frequent first, ties in level order.

    The level list is metadata that becomes column names, so its size is
    checked: more than ``max_levels`` levels raises instead of pulling an
    unbounded list to the driver."""
    rows = (df.where(F.col(c).isNotNull()).groupBy(c).count()
            .orderBy(F.desc("count"), F.asc(c)).limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{c} has more than {max_levels} levels; dummy columns are not a fit")
    return [r[0] for r in rows]


def dummies(df: DataFrame, cols: Sequence[str], drop: str | None = "most_frequent",
            levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """0/1 columns ``{col}_{level}``; NULL input gives NULL dummies.
    With ``drop='most_frequent'`` the modal level gets no column."""
    out = {}
    for c in cols:
        lv = list(levels[c]) if levels and c in levels else levels_by_frequency(df, c)
        keep = lv[1:] if drop == "most_frequent" and lv else lv
        for level in sorted(keep, key=str):
            out[f"{c}_{level}"] = (F.col(c) == F.lit(level)).cast("int")
    return df.withColumns(out)


def level_dictionary(df: DataFrame, c: str, name: str = "level_index") -> DataFrame:
    """(level, n, index): non-NULL levels numbered from 0 by falling count, ties in level order, however many there are."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    numbered = global_row_number(counts, [F.col("n").desc(), "level"], name)
    return numbered.withColumn(name, F.col(name) - 1)


def sparse_levels(df: DataFrame, cols: Sequence[str], drop: str | None = "most_frequent") -> tuple[DataFrame, int]:
    """R5 without a limit on the levels: one-hot codes as a sparse list in place of columns.

    Adds ``hot`` (array of positions, one for each column whose level has one,
    rising) and returns the number of positions.  Columns follow each other in the given
    order, levels by falling count; with ``drop='most_frequent'`` the modal level has no position.  A
    NULL value makes ``hot`` NULL, as dummies of NULL are NULL."""
    out, size, at, missing = df, 0, [], F.lit(False)
    first = 1 if drop == "most_frequent" else 0
    for i, c in enumerate(cols):
        d = cut_lineage(level_dictionary(df, c, f"_i{i}").drop("n"))
        levels = d.count()
        out = out.join(d.withColumnRenamed("level", f"_l{i}"), F.col(c) == F.col(f"_l{i}"), "left").drop(f"_l{i}")
        at.append(F.when(F.col(f"_i{i}") >= first, F.col(f"_i{i}") - first + size))
        missing = missing | F.col(c).isNull()
        size += max(levels - first, 0)
    hot = F.when(~missing, F.array_compact(F.array(*at)))
    return out.withColumn("hot", hot).drop(*[f"_i{i}" for i in range(len(cols))]), size


def sparse_vector(df: DataFrame, size: int, hot: str = "hot", out: str = "features") -> DataFrame:
    """ML sparse vectors with ones at the positions ``hot``; NULL positions give NULL."""
    from pyspark.ml.linalg import VectorUDT

    @F.pandas_udf(VectorUDT())
    def vector(at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"type": 0, "size": size, "indices": at, "values": at.map(lambda x: [1.0] * len(x))})

    full = F.coalesce(F.col(hot).cast("array<int>"), F.array().cast("array<int>"))
    return df.withColumn(out, F.when(F.col(hot).isNotNull(), vector(full)))


def design_matrix(df: DataFrame, cols: Sequence[str], out: str = "features",
                  keep: bool = True) -> DataFrame:
    """Numeric design matrix without intercept.  Booleans become
    ``{name}TRUE`` 0/1 columns; the assembled vector keeps the column order.
    Columns are always chosen by name, never by a positional mask (Q11)."""
    from pyspark.ml.feature import VectorAssembler

    types = {f.name: f.dataType for f in df.schema.fields}
    names, exprs = [], {}
    for c in cols:
        n = f"{c}TRUE" if isinstance(types[c], T.BooleanType) else c
        exprs[n] = F.col(c).cast("double")
        names.append(n)
    wide = df.withColumns(exprs)
    va = VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep")
    res = va.transform(wide)
    return res if keep else res.select(out)
