"""NULL algebra shared by every operator (rules N1-N15).

The source semantics have a single missing-value concept (NA); Spark has NULL.
These helpers pin down the few places where the defaults differ.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_", "if_na", "is_in", "sum0", "count_where", "count_present", "max_na",
           "n_distinct_na", "first_by", "rate", "pct_diff", "fill_value", "safe_corr"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_na(cond: Column, a, b) -> Column:
    """Two-branch conditional whose result is NULL when ``cond`` is NULL.
    ``when().otherwise()`` would send NULL conditions to the else branch."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(cond, a).when(~cond, b)


def is_in(c, values: Iterable) -> Column:
    """Set membership that is never NULL (N15): NULL input -> false."""
    return F.coalesce(col_(c).isin(list(values)), F.lit(False))


def sum0(c) -> Column:
    """Sum that treats an empty / all-NULL group as 0."""
    return F.coalesce(F.sum(col_(c)), F.lit(0))


def count_where(cond: Column) -> Column:
    """``sum(cond, na.rm=TRUE)``: rows where cond is true; NULL cond not counted."""
    return F.count_if(cond)


def count_present(c) -> Column:
    """``sum(!is.na(x))``."""
    return F.count(col_(c))


def max_na(c) -> Column:
    """``max(x, na.rm=TRUE)``; empty -> NULL instead of -Inf."""
    return F.max(col_(c))


def n_distinct_na(c) -> Column:
    """Distinct count that counts NULL as one more value."""
    c = col_(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def first_by(c, *order) -> Column:
    """Value of ``c`` on the first row by ``order`` (A7).  Algebraic, so it is
    combined map-side; never depends on physical row order."""
    key = col_(order[0]) if len(order) == 1 else F.struct(*[col_(o) for o in order])
    return F.min_by(col_(c), key)


def rate(num, den) -> Column:
    """Ratio that is NULL when the denominator is 0 or NULL."""
    return F.try_divide(col_(num), col_(den))


def pct_diff(a, b) -> Column:
    """``100 * (a / b - 1)``."""
    return F.lit(100.0) * (rate(a, b) - F.lit(1.0))


def fill_value(c, cond: Column, value) -> Column:
    """Fill a NULL with ``value`` only where ``cond`` holds."""
    c = col_(c)
    return F.when(c.isNull() & cond, F.lit(value)).otherwise(c)


def safe_corr(a, b) -> Column:
    """Pearson correlation over pairwise-complete rows that is NULL (not an
    ANSI divide-by-zero error) when either side is constant."""
    a, b = col_(a), col_(b)
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(a2, b2), F.sqrt(F.var_samp(a2) * F.var_samp(b2)))
