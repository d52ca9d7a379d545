"""Packing into optimal length buckets.

The lengths of all documents form one histogram with the exact lengths as keys (no
more of them than the longest text has words).  Dynamic programming over it chooses at most ``buckets`` upper
bounds that minimise the total padding (sum of bound - length); the best last
boundary moves monotonically, so each bucket takes O(keys log keys).

Inside a bucket documents are padded to its bound and batches of
``max(1, budget // bound)`` documents form in the order of a seeded hash.
Ranks are exact and no bucket goes through one task: the order is cut into
``SLICES`` hash ranges, ranges are counted first, and row numbers run within a range.

Defined results: length counts words between ASCII white space; a NULL or
empty text has length 0, its own bucket bound 0 when it pays and batches of
``budget`` documents.  Ties of padding go to the smaller bounds.  A document
longer than the budget is a batch of its own.  Repeated rows get places of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import n_words, table
from sidelines.session import cut_lineage

SLICES = 1024


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, of least padding; ``lengths`` sorted and distinct.

    cost[k][j]: least padding of the first j keys in k buckets
    = min over i < j of cost[k - 1][i] + sum over (i, j] of n (l_j - l).
    """
    l, n = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    size = len(l)
    if size == 0:
        return []
    docs, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * l)])

    def pad(i, j):
        return (docs[j] - docs[i]) * l[j - 1] - (tokens[j] - tokens[i])

    cost = np.concatenate([[0.0], [pad(0, j) for j in range(1, size + 1)]])
    back = []
    for _ in range(1, min(buckets, size)):
        new, choice = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        new[0] = 0.0
        todo = [(1, size, 0, size - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + pad(i, j)
            at = int(np.argmin(total))
            new[j], choice[j] = total[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        back.append(choice)
        cost = new
    bounds, j = [], size
    for choice in reversed(back):
        bounds.append(int(l[j - 1]))
        j = int(choice[j])
        if j == 0:
            return sorted(bounds)
    bounds.append(int(l[j - 1]))
    return sorted(set(bounds))


def pack(docs: DataFrame, budget: int = 65536, buckets: int = 16, seed: int = 7, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, bound, batch (per bound, from 0), place (in the batch, from 0)."""
    length = (n_words(F.col("text")) if tokens is None else tokens).alias("n_tokens")
    d = cut_lineage(docs.select(F.col(id_col).alias("id"), length))
    hist = np.array(sorted(tuple(r) for r in d.groupBy("n_tokens").count().collect()), np.int64).reshape(-1, 2)
    bounds = best_bounds(hist[:, 0], hist[:, 1], buckets)
    bound = F.lit(None).cast("bigint")
    for b in reversed(bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("bigint")).otherwise(bound)
    rank = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = (d.withColumn("bound", bound).withColumn("rank", rank)
              .withColumn("slice", F.shiftrightunsigned(F.col("rank"), 54).cast("int")))
    ahead = Window.partitionBy("bound").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (placed.groupBy("bound", "slice").count()
              .withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count"))
    within = Window.partitionBy("bound", "slice").orderBy("rank", "id", "n_tokens")
    numbered = placed.withColumn("nth", F.row_number().over(within)).join(slices, ["bound", "slice"])
    per_batch = F.greatest(F.lit(1), F.expr(f"{int(budget)} div greatest(bound, 1)"))
    pos = F.col("ahead") + F.col("nth") - 1
    return (numbered.withColumn("pos", pos).withColumn("per", per_batch.cast("bigint"))
            .select("id", "n_tokens", "bound", F.expr("pos div per").alias("batch"), (F.col("pos") % F.col("per")).alias("place")))


@register("op7_length_packing")
def op7_length_packing(spark, sf_dir):
    """Length bucket, batch and place of every document."""
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
