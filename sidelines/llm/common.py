"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the corpus: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def lower_az(col: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``translate`` walks the text letter by letter; a text of ASCII only (as
    many bytes as code points) gives the same by ``lower``, several times
    faster.
    """
    return (F.when(F.octet_length(col) == F.char_length(col), F.lower(col))
            .otherwise(F.translate(col, UPPER, UPPER.lower())))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; NULL for a NULL id."""
    return F.crc32(id_col.cast("string").cast("binary")) % m


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")
