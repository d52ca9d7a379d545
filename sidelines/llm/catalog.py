"""Registry of the training-data queries: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sidelines.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as query ``name``, with its SQL if there is one."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load() -> tuple[dict, dict]:
    import importlib
    for m in MODULES:
        importlib.import_module(f"sidelines.llm.{m}")
    import corpus_pipeline
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
    return QUERIES, ORACLE


MODULES = ("pii", "ngram_lm", "fingerprints", "licenses", "exact_dedup", "url_filter", "packing", "language", "jaccard_join", "mixing",
           "infill", "repetition", "whitening")
