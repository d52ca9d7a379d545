"""Mix sources to target weights by hierarchical budgeting.

Native: DataFrame functions only.

A tree of keys (domain, language, source) ends in leaves that hold documents.
A node's capacity is its tokens times ``max_epochs``.  The budget goes down
the tree level by level: a parent's budget is shared among its children by
weight, and what a child cannot hold goes to its siblings by their weights
(water filling, in closed form with prefix sums over the children in order of
capacity per weight).  As a child's capacity covers its whole subtree, a
shortage leaves its parent only when all siblings are full, that is siblings
come before ancestors.

A leaf takes whole epochs of its documents while its share lasts, and of the
next epoch a prefix in a seeded order (MD5 of seed, epoch and id) as long as
the running token sum fits.  The running sum is exact and never runs over a
leaf in one task: the order is cut into ``16 ** SLICE`` ranges by the first
digits of the MD5, ranges are summed first, and windows run within a range.

All shares are whole tokens computed in integers, so any engine gets the same.

Defined results: a NULL key is a node named '<null>'; a key that has no weight
gets 1, a weight of 0 gives no tokens.  A document without words (NULL or empty
text) holds no tokens and is never selected.  Repeated rows are selected one by
one, ties in the order going to the row with fewer tokens.  An empty table
gives no rows.  At most (children - 1) tokens per parent are lost to rounding.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import n_words, table
from sidelines.session import cut_lineage

SLICE = 3
SALTS = 64


def _weight(key: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1).cast("bigint")
    for k, w in weights.items():
        out = F.when(key == k, F.lit(w).cast("bigint")).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], key: str, budget: str, cap: str, weight: Column) -> DataFrame:
    """Adds ``share``: the node's part of its parent's ``budget``."""
    w = nodes.withColumn("w", weight).withColumn("c", F.when(F.col("w") > 0, F.col(cap)).otherwise(F.lit(0).cast("bigint")))
    w = w.withColumn("ratio", F.when(F.col("w") > 0, F.col("c").cast("double") / F.col("w")).otherwise(F.lit(0.0)))
    one = Window.partitionBy(*parents)
    order = one.orderBy("ratio", key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = (w.withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
         .withColumn("w_rest", F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("full", F.col("c") * F.col("w_rest") <= (F.col(budget) - F.col("c_before")) * F.col("w")))
    w = (w.withColumn("c_full", F.sum(F.when(F.col("full"), F.col("c")).otherwise(F.lit(0))).over(one))
         .withColumn("w_open", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(one)))
    share = (F.when(F.col("full"), F.col("c"))
             .otherwise(F.expr(f"({budget} - c_full) * w div w_open")))
    return w.withColumn("share", share).drop("w", "c", "ratio", "c_before", "w_rest", "full", "c_full", "w_open")


def leaf_shares(leaves: DataFrame, keys: Sequence[str], weights: Sequence[Mapping[str, int]], budget_num: int, budget_den: int,
                max_epochs: int) -> DataFrame:
    """(keys.., tokens, share) per leaf.  ``leaves``: one row per leaf with its tokens."""
    top = "root"
    wanted = F.lit(True)
    for k, w in zip(keys, weights):
        wanted = wanted & (_weight(F.col(k), w) > 0)
    level = (leaves.withColumn(top, F.lit(0))
             .withColumn("cap", F.when(wanted, F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("bigint")))
             .withColumn("budget", F.expr(f"sum(tokens) OVER (PARTITION BY {top}) * {budget_num} div {budget_den}")))
    out = level
    for i, k in enumerate(keys):
        parents = [top, *keys[:i]]
        nodes = out.groupBy(*parents, k).agg(F.sum("cap").alias("node_cap"), F.first("budget").alias("budget"))
        shares = _share(nodes, parents, k, "budget", "node_cap", _weight(F.col(k), weights[i])).drop("node_cap", "budget")
        out = out.join(shares, [*parents, k]).drop("budget").withColumnRenamed("share", "budget")
    return out.select(*keys, "tokens", F.col("budget").alias("share"))


def mix(docs: DataFrame, keys: Mapping[str, Column], weights: Sequence[Mapping[str, int]], budget_num: int, budget_den: int,
        max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """Selected rows: id, one column per key, tokens, epoch (from 0).

    ``keys``: name -> column, from the root down.  ``weights``: for each level
    node name -> whole-number weight.  The budget is
    ``all tokens * budget_num / budget_den``.
    """
    names = list(keys)
    counted = (n_words(F.col("text")) if tokens is None else tokens).alias("tokens")
    named = [F.coalesce(c.cast("string"), F.lit("<null>")).alias(k) for k, c in keys.items()]
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), *named, counted).filter("tokens > 0"))
    leaves = cut_lineage(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    plan = (leaf_shares(leaves, names, weights, budget_num, budget_den, max_epochs)
            .select(*names, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("part")))
    # a leaf may hold a third of all rows: each leaf's plan is repeated for ``SALTS`` parts of its rows
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*names, "salt"]).drop("salt")
    whole = placed.filter("whole > 0").select(
        "id", *names, "tokens", F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch"))
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
                 .cast("binary"))
    part = (placed.filter("part > 0").withColumn("rank", rank).withColumn("slice", F.substring("rank", 1, SLICE)))
    over_slices = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (part.groupBy(*names, "slice").agg(F.sum("tokens").alias("held"))
              .withColumn("ahead", F.coalesce(F.sum("held").over(over_slices), F.lit(0))).drop("held"))
    within = Window.partitionBy(*names, "slice").orderBy("rank", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    # ``ahead`` is joined to the slice's rows after their running sum, so that both sides share one partitioning
    prefix = (part.withColumn("upto", F.sum("tokens").over(within)).join(slices, [*names, "slice"])
              .filter("ahead + upto <= part").select("id", *names, "tokens", F.col("whole").alias("epoch")))
    return whole.unionByName(prefix)


#: Target weights of domains, languages and sources.  domain2 is to have more than it can hold, so its shortage goes to the others.
DOMAINS = {"domain0": 1, "domain1": 2, "domain2": 30, "domain3": 3}
#: Targets of the pipeline, which keeps every language, and of the query, which leaves one out.
WEIGHTS: tuple[dict, ...] = (DOMAINS, {"en": 4, "de": 2}, {})
TARGETS: tuple[dict, ...] = (DOMAINS, {"en": 4, "de": 2, "es": 0}, {"src1": 5})
SEED, BUDGET, EPOCHS = 7, (9, 10), 2


def corpus_keys() -> dict[str, Column]:
    """Domain (the source's number modulo 4), language, source."""
    number = F.regexp_extract("source", r"(\d+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (number.cast("bigint") % 4).cast("string")))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def _weight_sql(key: str, weights: Mapping[str, int]) -> str:
    cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.items())
    return f"CASE {key}{cases} ELSE 1 END" if cases else "1"


def _level_sql(name: str, src: str, parents: list[str], key: str, weights: Mapping[str, int]) -> str:
    p = ", ".join(parents)
    over = f"PARTITION BY {p}" if parents else ""
    by = ", ".join([*parents, key])
    on = "".join(f" AND s.{x} = l.{x}" for x in parents)
    return f"""
{name}_n AS (SELECT {by}, {_weight_sql(key, weights)} AS w, sum(cap) AS c0, min(budget) AS b FROM {src} GROUP BY {by}),
{name}_c AS (SELECT *, CASE WHEN w > 0 THEN c0 ELSE 0 END AS c, CASE WHEN w > 0 THEN CAST(c0 AS DOUBLE) / w ELSE 0 END AS r FROM {name}_n),
{name}_o AS (SELECT *, coalesce(sum(c) OVER ({over} ORDER BY r, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
    sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} ORDER BY r, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wr FROM {name}_c),
{name}_f AS (SELECT *, c * wr <= (b - cb) * w AS fl FROM {name}_o),
{name}_s AS (SELECT *, CASE WHEN fl THEN c ELSE (b - sum(CASE WHEN fl THEN c ELSE 0 END) OVER ({over})) * w
    // greatest(1, sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({over})) END AS share FROM {name}_f),
{name} AS (SELECT l.* EXCLUDE (budget), s.share AS budget FROM {src} l JOIN {name}_s s ON s.{key} = l.{key}{on}),"""


_WANTED = " AND ".join(f"{_weight_sql(k, w)} > 0" for k, w in zip(("domain", "language", "origin"), TARGETS))
ORACLE = rf"""
WITH rows AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '\d+$') THEN 'domain' || (CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4) ELSE '<null>' END AS domain,
         coalesce(lang, '<null>') AS language, coalesce(source, '<null>') AS origin,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
used AS (SELECT * FROM rows WHERE tokens > 0),
leaf AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY ALL),
l0 AS (SELECT *, CASE WHEN {_WANTED} THEN tokens * {EPOCHS} ELSE 0 END AS cap,
              CAST(sum(tokens) OVER () AS BIGINT) * {BUDGET[0]} // {BUDGET[1]} AS budget FROM leaf),
{_level_sql('l1', 'l0', [], 'domain', TARGETS[0])}{_level_sql('l2', 'l1', ['domain'], 'language', TARGETS[1])}
{_level_sql('l3', 'l2', ['domain', 'language'], 'origin', TARGETS[2])}
plan AS (SELECT domain, language, origin, budget // tokens AS whole, budget % tokens AS part FROM l3),
placed AS (SELECT u.*, p.whole, p.part FROM used u JOIN plan p USING (domain, language, origin)),
cut AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin
                                    ORDER BY md5('{SEED}:' || whole || ':' || doc_id), tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, language, origin, tokens, CAST(e.epoch AS BIGINT) AS epoch
FROM placed JOIN range(0, {EPOCHS}) AS e(epoch) ON e.epoch < whole
UNION ALL
SELECT doc_id, domain, language, origin, tokens, CAST(whole AS BIGINT) AS epoch FROM cut WHERE part > 0 AND upto <= part"""


@register("op10_source_mixing", ORACLE)
def op10_source_mixing(spark, sf_dir):
    """Documents (with epochs) that the domain-language-source budget selects."""
    return mix(table(spark, sf_dir, "documents"), corpus_keys(), TARGETS, *BUDGET, max_epochs=EPOCHS, seed=SEED).withColumnRenamed("id", "doc_id")
