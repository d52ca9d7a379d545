"""Variable importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.operators.windows import global_row_number
from sidelines.session import cut_lineage

__all__ = ["permuted", "permute_column", "permutation_importance", "coefficient_importance"]


def permuted(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: int, suffix: str = "_permuted") -> DataFrame:
    """``df`` with ``cols`` of another row each as ``{col}{suffix}``: an exact permutation of all rows.

    The row at place i by key gets the values of the row at place i by a seeded
    hash of the key.  Both numberings are range-partitioned and exact, so the
    permutation is the same at every size, and no task holds more than its
    range; one join on the place brings them together.  ``key`` must be unique.
    The hash is the MD5 of "seed:key:key..", which other engines compute alike."""
    key = list(key)
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary"))
    here = global_row_number(df, key, "_place")
    there = global_row_number(df.select(*key, *[F.col(c).alias(f"{c}{suffix}") for c in cols], text.alias("_h")), ["_h", *key], "_place")
    return here.join(there.drop(*key, "_h"), "_place").drop("_place")


def permute_column(df: DataFrame, c: str, key: Sequence[str], seed: int) -> DataFrame:
    """``df`` with the values of ``c`` exactly permuted over its rows."""
    out = permuted(df, [c], key, seed)
    return out.withColumn(c, F.col(f"{c}_permuted")).select(*df.columns)


def permutation_importance(predict: Callable[[DataFrame], DataFrame], df: DataFrame, cols: Sequence[str],
                           label: str, key: Sequence[str], seed: int = 42,
                           spark: SparkSession | None = None) -> DataFrame:
    """RMSE increase when one predictor is permuted (model re-scored).

    All predictors use one permutation, made and materialised once."""
    def rmse(d: DataFrame) -> float:
        e = F.col("prediction") - F.col(label)
        return predict(d).agg(F.sqrt(F.avg(e * e))).first()[0]
    both = cut_lineage(permuted(df.select(*{*key, *cols, label}), cols, key, seed))
    base = rmse(both)
    rows = [(c, float(rmse(both.withColumn(c, F.col(f"{c}_permuted"))) - base)) for c in cols]
    spark = spark or df.sparkSession
    return spark.createDataFrame(rows, "variable string, importance double")


def coefficient_importance(spark: SparkSession, coefficients: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Coefficients as a small table with absolute size and sign."""
    rows = [(n, float(c)) for n, c in zip(names, coefficients)]
    df = spark.createDataFrame(rows, "term string, estimate double")
    return df.withColumns({"importance": F.abs("estimate"),
                           "sign": F.when(F.col("estimate") >= 0, "POS").otherwise("NEG")})
