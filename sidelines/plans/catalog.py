"""Query catalogue: one Spark job per operator family, each paired (where SQL
can express it) with an independent DuckDB oracle over the same tables.

Names follow the operator ids of the blueprint.  Every query reads whole
tables (no sampling, no id subsets).  Float outputs are rounded to
``DIGITS`` places in both engines so order-dependent double sums hash equal.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.session import ship_package

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # executors' Python workers import the package
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Uniform output types: integers as BIGINT, floats as DOUBLE rounded."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            out[f.name] = F.col(f.name).cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            # round the scaled binary value (not its shortest decimal text), so
            # exact ties round like the SQL engines do
            scale = float(10 ** digits)
            out[f.name] = F.round(F.col(f.name).cast("double") * scale, 0) / scale
    return df.withColumns(out) if out else df


def load_all() -> tuple[dict, dict]:
    """Import every query module (registration side effect); return the
    query and oracle registries."""
    from sidelines.plans import q_impact, q_ml, q_plays, q_scenario, q_sources, q_tables, q_team  # noqa: F401
    return QUERIES, ORACLE
