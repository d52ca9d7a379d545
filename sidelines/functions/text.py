"""Text helpers: regex extraction, labels, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_

__all__ = ["extract", "detect", "label", "initial_name", "first_digits", "na_text",
           "WIND_PATTERN", "WEATHER_DESC_PATTERN", "PRECIP_MAYBE", "PRECIP_YES", "NA_TEXT"]

# Weather-text patterns of the source pipeline (Java regex dialect;
# the POSIX class [:print:] is written as [^\p{Cntrl}] because Java reads a bare
# [:print:] as a plain character set).
WIND_PATTERN = r"(?<=Wind:\D{0,30})\d{1,2}"
WEATHER_DESC_PATTERN = r"^[^\p{Cntrl}]+(?= Temp)"
NA_TEXT = r"(N|n)/(A|a)"
PRECIP_MAYBE = r"(C|c)hance|(C|c)hange|Threat|Expected|likely|Forecasted"
PRECIP_YES = r"(R|r)ain|(S|s)now|(S|s)hower|(D|d)rizzle|storms"


def extract(c, pattern: str, group: int = 0, may_match_empty: bool = False) -> Column:
    """First match of ``pattern`` or NULL when there is none.

    ``regexp_extract`` returns '' on no match, so for patterns that cannot
    match the empty string one evaluation plus ``nullif`` suffices; patterns
    that can match empty pay a second evaluation (``rlike``) to tell the cases
    apart."""
    c = col_(c)
    if may_match_empty:
        return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def detect(c, pattern: str) -> Column:
    """``str_detect``: NULL on NULL input."""
    return col_(c).rlike(pattern)


def label(*parts, sep: str = "") -> Column:
    """``paste``: pieces are column names or Columns; NULL prints as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(col_(p).cast("string"), F.lit("NA")) for p in parts])


def initial_name(first, last) -> Column:
    """``First Last`` -> ``F.Last``."""
    return F.concat(F.substring(col_(first), 1, 1), F.lit("."), col_(last))


def first_digits(c) -> Column:
    """First run of digits (as int) in the base name of a path (Q9)."""
    base = F.regexp_extract(col_(c), r"([^/]*)$", 1)
    return F.nullif(F.regexp_extract(base, r"\d+", 0), F.lit("")).try_cast("int")


def na_text(c, text: str = "NA") -> Column:
    """``na_if``."""
    return F.nullif(col_(c), F.lit(text))
