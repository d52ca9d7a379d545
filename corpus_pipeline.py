"""Corpus pipeline over ``documents``: language, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``, whatever further columns it has.  ``run``
writes each stage to the shared checkpoint folder and reads it again.

Defined results, besides those of the operators: rows without any letter, and
rows of which no language has two fifths of the letters, go in the first stage (all
rows stay when nothing has a label to learn from).  Of equal texts the smallest
id stays; rows with one id and one text are one document, of which one row
stays.  Of each near-duplicate group the smallest id stays.  Rows that share an
id but differ in text share the fate of their id in the stages that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import lower_az, table, text_or_empty
from sidelines.llm.exact_dedup import exact_groups
from sidelines.llm.jaccard_join import near_duplicates
from sidelines.llm.language import corpus_model, keep_identified
from sidelines.llm.mixing import SEED, WEIGHTS, corpus_keys, mix
from sidelines.llm.packing import pack
from sidelines.session import cut_lineage, ship_package

ORACLE_SQL = None       # language identification is not expressible in SQL


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (a column ``id``; NULL matches NULL)."""
    name = _free(docs, "kept_id")
    return docs.join(ids.select(F.col("id").alias(name)).distinct(), docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def language_id(spark, docs, sf_dir):
    ship_package(spark)
    return keep_identified(docs, corpus_model(docs), min_score=0.4)


def exact_dedup(spark, docs, sf_dir):
    ship_package(spark)
    sha, kept, kept_sha = (_free(docs, x) for x in ("sha", "kept_id", "kept_sha"))
    keep = exact_groups(docs, keep="min").filter("kept").select(F.col("id").alias(kept), F.col("sha").alias(kept_sha)).distinct()
    hashed = docs.withColumn(sha, F.unhex(F.sha2(lower_az(text_or_empty(F.col("text"))).cast("binary"), 256)))
    return (hashed.join(keep, F.col("doc_id").eqNullSafe(F.col(kept)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
            .dropDuplicates(["doc_id", sha]).drop(sha))


def near_dedup(spark, docs, sf_dir):
    ship_package(spark)
    groups = near_duplicates(docs, k=5, percent=80)
    return _with_ids(docs, groups.filter(F.col("id").eqNullSafe(F.col("component_id"))))


def source_mixing(spark, docs, sf_dir):
    ship_package(spark)
    return _with_ids(docs, mix(docs, corpus_keys(), WEIGHTS, 9, 10, max_epochs=1, seed=SEED))


def packing(spark, docs, sf_dir):
    ship_package(spark)
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("source_mixing", source_mixing), ("packing", packing)]


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; returns the packed rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
