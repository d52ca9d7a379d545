"""Equi-joins whose NULL keys match NULL keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

__all__ = ["join_on"]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the left side's keys stay."""
    names = {k: f"__key_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[names[k]]) for k in keys])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())
