"""Source and sink queries.

The given tables are parquet, so each query first writes the file layout of
its reader from a given table, below the shared checkpoint folder, then reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.ml.stack import penalty_path
from sidelines.operators.joins import cross_with
from sidelines.plans.catalog import finish, register
from sidelines.session import checkpoint_dir
from sidelines.sources.io import (baseline, load_overrides, load_plays, load_ratings, load_snapshot, read_csv_skip,
                                  read_indexed_csv, read_many, save_table, table)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("season", F.year("o_orderdate"))


@register("season_range_load", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS season, round(o_totalprice, 6) AS o_totalprice FROM orders
WHERE year(o_orderdate) IN (1994, 1995, 1997)""")
def q_season_range_load(spark, sf):
    """S1 + S8: a table partitioned by season; the asked seasons are read, others pruned by directory."""
    path = _folder(spark)
    save_table(_orders(spark, sf).select("o_orderkey", "o_totalprice", "season"), path, partition_by=["season"])
    return finish(load_plays(spark, path, [1994, 1995, 1997]).select("o_orderkey", "season", "o_totalprice"))


@register("snapshot_load", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal FROM customer")
def q_snapshot_load(spark, sf):
    """S2 + S8: a saved intermediate table read back."""
    path = _folder(spark)
    save_table(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return finish(load_snapshot(spark, path))


@register("override_csv", """
SELECT CAST(o_orderkey AS VARCHAR) AS game_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS roof_update FROM orders""")
def q_override_csv(spark, sf):
    """S3: header CSV under an explicit schema; empty fields are NULL."""
    path = _folder(spark)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("game_id"),
                                             F.nullif("o_orderstatus", F.lit("P")).alias("roof_update"))
    save_table(rows, path, fmt="csv")
    return load_overrides(spark, path)


@register("preamble_csv", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS series, count(*) AS n FROM orders GROUP BY 1, 2""")
def q_preamble_csv(spark, sf):
    """One file per series with two preamble lines before the header."""
    path = _folder(spark)
    monthly = (table(spark, sf, "orders").groupBy("o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
               .count())
    lines = F.array_sort(F.collect_list(F.concat_ws(",", F.col("month").cast("string"), "o_orderpriority", F.col("count").cast("string"))))
    text = F.concat(F.lit("Category: all\n\nMonth,Series,n\n"), F.array_join("lines", "\n"))
    files = monthly.groupBy("o_orderpriority").agg(lines.alias("lines")).select(text.alias("value"), "o_orderpriority")
    files.write.partitionBy("o_orderpriority").text(path)
    schema = T.StructType([T.StructField("month", T.DateType()), T.StructField("series", T.StringType()), T.StructField("n", T.LongType())])
    return finish(read_csv_skip(spark, path, 2, schema))


_POINTS = T.StructType([T.StructField("player", T.LongType()), T.StructField("points", T.DoubleType())])


@register("many_csv", """
SELECT c_custkey AS player, round(c_acctbal, 6) AS points, c_mktsegment AS source_part FROM customer""")
def q_many_csv(spark, sf):
    """S5 + X4: many CSV files at once; the file path tells which one a row came from."""
    path = _folder(spark)
    save_table(table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("points"), "c_mktsegment"),
               path, fmt="csv", partition_by=["c_mktsegment"])
    many = read_many(spark, f"{path}/*/*.csv", _POINTS)
    return finish(many.select("player", "points", F.regexp_extract("source_path", "c_mktsegment=([A-Z]+)", 1).alias("source_part")))


@register("indexed_csv", """
SELECT s_suppkey AS player, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 6) END AS points FROM supplier""")
def q_indexed_csv(spark, sf):
    """The leading index column is dropped; NA is NULL."""
    path = _folder(spark)
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("nr"), F.col("s_suppkey").alias("player"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("string")).otherwise(F.lit("NA")).alias("points"))
    save_table(rows, path, fmt="csv")
    return finish(read_indexed_csv(spark, path, _POINTS))


@register("baseline_row", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(2019 AS BIGINT) AS season, 'outdoors' AS roof, CAST(0.5 AS DOUBLE) AS spread FROM nation""")
def q_baseline_row(spark, sf):
    """S7 + J6: a literal one-row baseline on every row of a given table."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return finish(cross_with(baseline(spark, season=2019, roof="outdoors", spread=0.5), n))


@register("rating_files", """
SELECT CASE n_name WHEN 'IRAN' THEN 'IR' WHEN 'IRAQ' THEN 'IQ' ELSE n_name END AS Team,
       CAST(year(o_orderdate) AS BIGINT) AS season, count(*) AS Games
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1, 2""")
def q_rating_files(spark, sf):
    """One rating file per season: columns dropped, title-cased, renamed, tagged, codes fixed."""
    path = _folder(spark)
    rated = (_orders(spark, sf).where("season BETWEEN 1995 AND 1997")
             .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("season", F.col("n_name").alias("team")).agg(F.max("o_custkey").alias("rank"), F.count("*").alias("n games")))
    save_table(rated.select("rank", "team", "n games", "season"), path, fmt="csv", partition_by=["season"])
    schema = T.StructType([T.StructField("rank", T.LongType()), T.StructField("team", T.StringType()), T.StructField("n games", T.LongType())])
    out = load_ratings(spark, {y: f"{path}/season={y}" for y in (1995, 1996, 1997)}, schema, drop=["rank"],
                       rename={"N Games": "Games"}, fix={"IRAN": "IR", "IRAQ": "IQ"})
    return finish(out.select("Team", "season", "Games"))


@register("power_sequence", """
SELECT i AS step, round(10 ** (-2 + i * (1.5 / 19)), 6) AS penalty, count(*) FILTER (WHERE l_discount >= 10 ** (-2 + i * (1.5 / 19)) - 1e-12) AS n
FROM lineitem CROSS JOIN range(20) AS r(i) GROUP BY i""")
def q_power_sequence(spark, sf):
    """The penalty path 10 ^ seq(-2, -0.5, 20), and the line items whose discount reaches each step."""
    path = penalty_path()
    l = table(spark, sf, "lineitem")
    found = l.agg(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("penalty"), F.count_if(F.col("l_discount") >= p - 1e-12).alias("n"))
                            for i, p in enumerate(path)]).alias("a"))
    return finish(found.select(F.inline("a")))
