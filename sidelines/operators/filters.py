"""Group-level filters and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.operators.nullsafe import join_on

__all__ = ["keep_groups", "single_actor", "time_split"]


def keep_groups(df: DataFrame, keys: Sequence[str], agg_cond: Column) -> DataFrame:
    """keep the rows of groups whose aggregate condition is true
    (aggregate map-side, then a semi join); a NULL key is a group."""
    ok = df.groupBy(*keys).agg(agg_cond.alias("__ok")).where("__ok").drop("__ok")
    return join_on(df, ok, list(keys), "left_semi")


def single_actor(df: DataFrame, keys: Sequence[str], actor: str, keep_empty: bool = True,
                 n_col: str = "n_actors") -> DataFrame:
    """F7 on an aggregated table: keep rows whose ``n_col`` (NULL-counting
    distinct actors) is 1, or NULL when the group had no facts."""
    c = F.col(n_col)
    return df.where((c == 1) | c.isNull()) if keep_empty else df.where(c == 1)


def time_split(df: DataFrame, c: str, cut) -> tuple[DataFrame, DataFrame]:
    """train = before ``cut``, test = at ``cut``."""
    return df.where(F.col(c) < F.lit(cut)), df.where(F.col(c) == F.lit(cut))

