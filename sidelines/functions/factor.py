"""Factors: ordered levels with labels (P7) as a label column plus an ordinal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_

__all__ = ["factor_label", "factor_ordinal", "as_factor"]


def _lookup(levels: Sequence, values: Sequence) -> Column:
    return F.create_map(*[F.lit(x) for kv in zip(levels, values) for x in kv])


def factor_label(c, levels: Sequence, labels: Sequence | None = None) -> Column:
    """Label for each level; values outside ``levels`` (and NULL) -> NULL."""
    labels = list(labels) if labels is not None else [str(v) for v in levels]
    return F.try_element_at(_lookup(levels, labels), col_(c))


def factor_ordinal(c, levels: Sequence) -> Column:
    """1-based position of the level; NULL when unknown.  Sorting by it gives
    factor order (O2), ``desc`` gives ``fct_rev`` (P8)."""
    return F.try_element_at(_lookup(levels, list(range(1, len(levels) + 1))), col_(c))


def as_factor(c, levels: Sequence, labels: Sequence | None = None, name: str | None = None):
    """Returns ``(label_col, ordinal_col)`` aliased ``name`` and ``name_ord``."""
    name = name or (c if isinstance(c, str) else "factor")
    return (factor_label(c, levels, labels).alias(name),
            factor_ordinal(c, levels).alias(f"{name}_ord"))
