"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups.

Native: DataFrame functions only.  The text is read twice and never sorted:

1. one scan writes id, MD5 and SHA-256 of the normalised text (a few dozen
   bytes a row) to the shared checkpoint folder; MD5 groups are counted with
   map-side partial sums, so a group of any size costs one row per task;
2. texts of rows whose MD5 occurs twice or more (and no others) are grouped by
   (MD5, text).  The grouping compares the bytes themselves, again map-side
   first, which separates texts that only share an MD5.

Rows find their class by MD5 and SHA-256, not by carrying texts through a join.

Defined results: a NULL text counts as empty; empty texts are one group.  A
NULL id is smaller than any other, so it stays only if all ids of its group
are NULL.  Rows repeated with the same id count in the group's size and share
one verdict.  An empty table gives no rows.  Further columns of the input, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import lower_az, table, text_or_empty
from sidelines.session import cut_lineage


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 content_hash=lambda c: F.unhex(F.md5(c.cast("binary")))) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``sha`` (binary).

    ``keep`` names which id of a group stays, 'min' or 'max'.  ``content_hash``
    maps the normalised text to the grouping hash; tests pass a weak one to
    force collisions.
    """
    norm = lower_az(text_or_empty(F.col(text_col)))
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    hashed = cut_lineage(texts.select("id", content_hash(F.col("norm")).alias("h"),
                                      F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.max("sha").alias("sha"))
    alone = counts.filter("n = 1").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                          "sha")
    shared = hashed.join(counts.filter("n > 1").select("h"), "h")
    ids = shared.select(F.col("id").alias("shared_id")).distinct()
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    again = (raw.join(ids.hint("merge"), F.col("id").eqNullSafe(F.col("shared_id")), "left_semi")
             .select("id", lower_az(text_or_empty(F.col("t"))).alias("norm"))
             .withColumn("h", content_hash(F.col("norm"))))
    best = {"min": F.min, "max": F.max}[keep]
    classes = (again.groupBy("h", "norm").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size"))
    members = shared.join(classes, ["h", "sha"]).select("id", "keep_id", "group_size", "sha")
    return (alone.unionByName(members)
            .select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"))


def _hex(c: str) -> Column:
    return F.lower(F.hex(F.col(c)))


@register("op5_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""")
def op5_exact_dedup(spark, sf_dir):
    """Exact duplicates of all documents; the largest doc_id of a group stays."""
    g = exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", _hex("sha").alias("text_sha256"))
