"""Sorts, top-k and ranked boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelines.operators.windows import global_row_number

__all__ = ["sort_na_last", "top_n", "ranked_board", "first_row"]


def sort_na_last(df: DataFrame, *cols: str, desc: Sequence[str] = ()) -> DataFrame:
    """Multi-key sort, NULL last in either direction (range-partitioned)."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if c in desc else F.col(c).asc_nulls_last()
                        for c in cols])


def top_n(df: DataFrame, metric: str, n: int, keys: Sequence[str] = (), desc: bool = False,
          tiebreak: Sequence[str] = (), rank_col: str | None = None) -> DataFrame:
    """O3: best ``n`` rows (overall, or per group).

    Overall: ``orderBy().limit()`` runs as a per-partition top-k merge.
    Per group: ``row_number() <= n`` which Spark executes as a partial
    group-limit before the shuffle, so a hot group sends at most n rows per
    input partition."""
    m = F.col(metric).desc_nulls_last() if desc else F.col(metric).asc_nulls_last()
    order = [m, *[F.col(t).asc_nulls_last() for t in tiebreak]]
    if not keys:
        out = df.orderBy(*order).limit(n)
        if rank_col:
            out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return out
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank_col) if rank_col else out.drop("__rn")


def first_row(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``slice(1)`` on a defined order."""
    return df.orderBy(*[F.col(o).asc_nulls_last() for o in order]).limit(1)


def ranked_board(df: DataFrame, score: str, keys: Sequence[str] = (), rank_col: str = "rank",
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Every row with its descending-score rank inside ``keys``.

    Uses the range-partitioned global numbering, so a large board is ranked
    in parallel rather than in one window task.  NULL scores rank last; NULL
    keys are a board of their own."""
    return global_row_number(df, [F.col(score).desc_nulls_last(), *tiebreak], name=rank_col, keys=keys)
