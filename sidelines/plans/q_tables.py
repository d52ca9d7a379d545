"""Queries over the star-schema tables (orders, lineitem, customer, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidelines.functions.domain import by_role, goal_to_go, implied_totals
from sidelines.functions.factor import factor_label, factor_ordinal
from sidelines.functions.nulls import fill_value, if_na, is_in, n_distinct_na, rate
from sidelines.functions.text import (NA_TEXT, PRECIP_MAYBE, PRECIP_YES, WEATHER_DESC_PATTERN,
                                      WIND_PATTERN, detect, extract, first_digits, initial_name, label,
                                      na_text)
from sidelines.operators.aggregates import (corr_pairwise, hexbin, histogram, quantiles, scalar,
                                            summarise)
from sidelines.operators.filters import keep_groups, time_split
from sidelines.operators.joins import (apply_patches, densify, enrich, normalise_codes, opponent_role,
                                       override, with_fallback_row)
from sidelines.operators.ordering import first_row, ranked_board, top_n
from sidelines.operators.reshape import (across_numeric, append, cast_all, design_matrix, dummies,
                                         pivot_longer, pivot_wider, separate, sparse_levels, stack_rows)
from sidelines.operators.windows import global_row_number, season_lag, with_totals
from sidelines.plans.catalog import finish, register
from sidelines.plans.context import clean_weather
from sidelines.sources.io import table


def t(spark, sf, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf, name)


# ---------------------------------------------------------------- aggregates

@register("single_actor_filter", """
WITH f AS (SELECT l_orderkey, count(*) AS n_lines,
                  count(DISTINCT l_suppkey) + max(CASE WHEN l_suppkey IS NULL THEN 1 ELSE 0 END) AS n_supp
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey, coalesce(f.n_lines, 0) AS n_lines, f.n_supp
FROM orders o LEFT JOIN f ON o.o_orderkey = f.l_orderkey
WHERE f.n_supp = 1 OR f.n_supp IS NULL""")
def q_single_actor_filter(spark, sf):
    """F7 (+J3): orders whose lines come from one supplier, or have no lines."""
    li = t(spark, sf, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), n_distinct_na("l_suppkey").alias("n_supp"))
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = densify(f, o, ["o_orderkey"], ["n_lines"])
    return finish(out.where((F.col("n_supp") == 1) | F.col("n_supp").isNull()))


@register("median_iqr_sd", """
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 6) AS median_price,
       round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr_price,
       round(stddev_samp(o_totalprice), 6) AS sd_price, count(*) AS n
FROM orders GROUP BY o_orderstatus""", headline=True)
def q_median_iqr_sd(spark, sf):
    """Exact type-7 median and IQR per status (each status holds
    about a third of all orders: the skew-safe quantile operator) and the
    sample standard deviation."""
    o = t(spark, sf, "orders")
    q = quantiles(o, ["o_orderstatus"], "o_totalprice", {"p25": 0.25, "median_price": 0.5, "p75": 0.75})
    sd = o.groupBy("o_orderstatus").agg(F.stddev_samp("o_totalprice").alias("sd_price"),
                                        F.count(F.lit(1)).alias("n"))
    out = sd.join(q, "o_orderstatus", "left")
    return finish(out.select("o_orderstatus", "median_price", (F.col("p75") - F.col("p25")).alias("iqr_price"),
                             "sd_price", "n"))


@register("two_level_median", """
WITH m AS (SELECT o_custkey, year(o_orderdate) AS yr, avg(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT CAST(yr AS BIGINT) AS yr, round(quantile_cont(m, 0.5), 6) AS median_cust_mean, count(*) AS n_customers
FROM m GROUP BY yr""")
def q_two_level_median(spark, sf):
    """Customer-year mean, then the yearly median of those means."""
    o = t(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    m = o.groupBy("o_custkey", "yr").agg(F.avg("o_totalprice").alias("m"))
    med = quantiles(m, ["yr"], "m", {"median_cust_mean": 0.5})
    n = m.groupBy("yr").agg(F.count(F.lit(1)).alias("n_customers"))
    return finish(n.join(med, "yr", "left"))


@register("ratio_of_sums", """
SELECT l_returnflag, l_linestatus,
  round(sum(l_extendedprice * (1 - l_discount)) / nullif(sum(l_extendedprice), 0), 6) AS net_share,
  round(sum(l_extendedprice * l_tax) / nullif(sum(l_extendedprice * l_discount), 0), 6) AS tax_per_discount,
  round(sum(CASE WHEN l_discount > 0.5 THEN l_quantity END)
        / nullif(sum(CASE WHEN l_discount > 0.5 THEN 1 ELSE 0 END), 0), 6) AS deep_discount_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_ratio_of_sums(spark, sf):
    """A12 + N6: ratios of sums; 0/0 gives NULL, not an error or NaN."""
    li = t(spark, sf, "lineitem")
    deep = F.col("l_discount") > 0.5
    return finish(summarise(
        li, ["l_returnflag", "l_linestatus"],
        net_share=rate(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), F.sum("l_extendedprice")),
        tax_per_discount=rate(F.sum(F.col("l_extendedprice") * F.col("l_tax")),
                              F.sum(F.col("l_extendedprice") * F.col("l_discount"))),
        deep_discount_qty=rate(F.sum(F.when(deep, F.col("l_quantity"))), F.sum(F.when(deep, 1).otherwise(0)))))


@register("correlation", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr_qty_price,
       round(corr(nullif(l_tax, 0), l_discount), 6) AS corr_tax_disc
FROM lineitem GROUP BY l_returnflag""")
def q_correlation(spark, sf):
    """Pearson correlation over pairwise-complete rows."""
    li = t(spark, sf, "lineitem").withColumn("tax_nz", F.nullif("l_tax", F.lit(0.0)))
    a = corr_pairwise(li, "l_quantity", "l_extendedprice", ["l_returnflag"], "corr_qty_price")
    b = corr_pairwise(li, "tax_nz", "l_discount", ["l_returnflag"], "corr_tax_disc")
    return finish(a.join(b, "l_returnflag"))


@register("hexbin_counts", """
WITH b AS (SELECT l_quantity / 5.0 AS u, l_extendedprice / 10000.0 AS v FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
c AS (SELECT u, v, round(u) AS au, round(v) AS av, floor(u) + 0.5 AS bu, floor(v) + 0.5 AS bv FROM b),
d AS (SELECT *, (u - au) * (u - au) + 3 * (v - av) * (v - av) AS da,
                (u - bu) * (u - bu) + 3 * (v - bv) * (v - bv) AS db FROM c)
SELECT round(CASE WHEN da <= db THEN au ELSE bu END * 5.0, 6) AS hex_x,
       round(CASE WHEN da <= db THEN av ELSE bv END * 10000.0, 6) AS hex_y, count(*) AS n
FROM d GROUP BY ALL""")
def q_hexbin_counts(spark, sf):
    """Hexagonal 2-D cell counts."""
    return finish(hexbin(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", (5.0, 10000.0)))


@register("histogram", """
SELECT CAST(least(floor((l_extendedprice - 0.0) / 4000.0), 24) AS BIGINT) AS bin, count(*) AS n,
       round(0.0 + least(floor((l_extendedprice - 0.0) / 4000.0), 24) * 4000.0, 6) AS bin_lo,
       round(0.0 + (least(floor((l_extendedprice - 0.0) / 4000.0), 24) + 1) * 4000.0, 6) AS bin_hi
FROM lineitem WHERE l_extendedprice BETWEEN 0.0 AND 100000.0 GROUP BY ALL""")
def q_histogram(spark, sf):
    """A18 + A19: equal-width histogram with values beyond the axis limit dropped."""
    return finish(histogram(t(spark, sf, "lineitem"), "l_extendedprice", 25, (0.0, 100000.0)))


# ---------------------------------------------------------------- windows

@register("partition_totals", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cust_total,
  count(*) OVER (PARTITION BY o_custkey) AS cust_orders,
  round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share
FROM orders""")
def q_partition_totals(spark, sf):
    """Group totals attached to every row (aggregate + join, skew-safe)."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = with_totals(o, ["o_custkey"], cust_total=F.sum("o_totalprice"), cust_orders=F.count(F.lit(1)))
    return finish(out.withColumn("share", rate("o_totalprice", "cust_total")))


@register("season_lag", """
WITH c AS (SELECT o_custkey, year(o_orderdate) AS yr, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(yr AS BIGINT) AS yr, round(total, 6) AS total,
       round(lag(total) OVER (PARTITION BY o_custkey ORDER BY yr), 6) AS lag_total
FROM c""")
def q_season_lag(spark, sf):
    """Previous season's value within the entity."""
    o = t(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    c = o.groupBy("o_custkey", "yr").agg(F.sum("o_totalprice").alias("total"))
    return finish(season_lag(c, ["o_custkey"], ["yr"], ["total"]))


# ---------------------------------------------------------------- joins

@register("override_join", """
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer)
SELECT c_custkey, CASE WHEN seg IS NULL AND c_nationkey < 10 THEN n_name ELSE seg END AS seg
FROM c LEFT JOIN nation ON c.c_nationkey = nation.n_nationkey""")
def q_override_join(spark, sf):
    """Fill a missing attribute from a left-joined override table under a
    condition (like the roof override of one season)."""
    c = t(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg"))
    patch = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                          F.col("n_name").alias("seg_update"))
    out = override(c, patch, "c_nationkey", "seg", "seg_update", when=F.col("c_nationkey") < 10)
    return finish(out.select("c_custkey", "seg"))


# Hand-written patch rows (key, column, value, patch number).
PATCHES = [(3, "c_mktsegment", "PATCHED", 1), (3, "c_acctbal", "0.0", 2), (7, "c_acctbal", "100.5", 3),
           (7, "c_acctbal", "200.25", 4), (11, "c_mktsegment", "FIXED", 5)]


@register("patch_table", """
SELECT c_custkey,
  CASE WHEN c_custkey = 3 THEN 'PATCHED' WHEN c_custkey = 11 THEN 'FIXED' ELSE c_mktsegment END AS c_mktsegment,
  round(CASE WHEN c_custkey = 3 THEN 0.0 WHEN c_custkey = 7 THEN 200.25 ELSE c_acctbal END, 6) AS c_acctbal
FROM customer""")
def q_patch_table(spark, sf):
    """Keyed single-cell patches, the last patch of a cell wins."""
    p = spark.createDataFrame(PATCHES, "c_custkey long, column string, value string, patch_no int")
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return finish(apply_patches(c, p, "c_custkey", {"c_mktsegment": "string", "c_acctbal": "double"}))


@register("fallback_row", """
WITH dim AS (SELECT CAST(c_nationkey AS VARCHAR) AS k, avg(c_acctbal) AS avg_bal FROM customer
             WHERE c_nationkey < 20 GROUP BY c_nationkey
             UNION ALL SELECT 'Other', avg(c_acctbal) FROM customer)
SELECT c_custkey, round(coalesce(d.avg_bal, (SELECT avg_bal FROM dim WHERE k = 'Other')), 6) AS nation_avg_bal
FROM customer c LEFT JOIN (SELECT * FROM dim WHERE k <> 'Other') d ON CAST(c.c_nationkey AS VARCHAR) = d.k""")
def q_fallback_row(spark, sf):
    """Entities missing from a stats table take its ``Other`` row."""
    c = t(spark, sf, "customer")
    per = (c.where(F.col("c_nationkey") < 20).groupBy("c_nationkey")
           .agg(F.avg("c_acctbal").alias("avg_bal")).select(F.col("c_nationkey").cast("string").alias("k"), "avg_bal"))
    other = c.agg(F.avg("c_acctbal").alias("avg_bal")).select(F.lit("Other").alias("k"), "avg_bal")
    dim = append(per, other)
    cc = c.select("c_custkey", F.col("c_nationkey").cast("string").alias("nk"))
    out = with_fallback_row(cc, dim, "nk", "Other", ["avg_bal"], dim_key="k")
    return finish(out.select("c_custkey", F.col("avg_bal").alias("nation_avg_bal")))


@register("star_enrich", """
WITH ps AS (SELECT l_partkey, l_suppkey, count(*) AS ps_lines FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, o.o_custkey, n.n_name, r.r_name, p.p_brand,
       s.s_name, ps.ps_lines, round(l.l_extendedprice * (1 - l.l_discount), 6) AS revenue
FROM lineitem l
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN ps ON l.l_partkey = ps.l_partkey AND l.l_suppkey = ps.l_suppkey""", headline=True)
def q_star_enrich(spark, sf):
    """J8 (+J1, J2 composite key): chained left joins onto the fact rows.
    Dimension sides are joined as-is; AQE broadcasts those it measures small."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                         "l_extendedprice", "l_discount")
    ps = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("ps_lines"))
    out = enrich(li, t(spark, sf, "orders").select("o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"})
    out = enrich(out, t(spark, sf, "customer").select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    out = enrich(out, t(spark, sf, "nation"), {"c_nationkey": "n_nationkey"})
    out = enrich(out, t(spark, sf, "region"), {"n_regionkey": "r_regionkey"})
    out = enrich(out, t(spark, sf, "part").select("p_partkey", "p_brand"), {"l_partkey": "p_partkey"})
    out = enrich(out, t(spark, sf, "supplier").select("s_suppkey", "s_name"), {"l_suppkey": "s_suppkey"})
    out = enrich(out, ps, ["l_partkey", "l_suppkey"])
    return finish(out.select("l_orderkey", "l_linenumber", "o_custkey", "n_name", "r_name", "p_brand", "s_name",
                             "ps_lines", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))


@register("right_join_attributes", """
WITH f AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_mktsegment, f.n_orders, round(f.spend, 6) AS spend
FROM f RIGHT JOIN customer c ON f.o_custkey = c.c_custkey""")
def q_right_join_attributes(spark, sf):
    """Facts right-joined to the attribute table (all customers kept)."""
    f = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                                       F.sum("o_totalprice").alias("spend"))
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = enrich(f, c, {"o_custkey": "c_custkey"}, how="right")
    return finish(out.select("c_custkey", "c_mktsegment", "n_orders", "spend"))


@register("opponent_role_join", """
WITH ns AS (SELECT c.c_nationkey AS nk, sum(l.l_extendedprice) AS revenue, count(*) AS n_lines
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
            GROUP BY c.c_nationkey)
SELECT s.s_suppkey, CAST(s.s_nationkey AS BIGINT) AS s_nationkey, round(own.revenue, 6) AS own_revenue, round(opp.revenue, 6) AS opp_revenue,
       opp.n_lines AS opp_lines
FROM supplier s LEFT JOIN ns own ON s.s_nationkey = own.nk
LEFT JOIN ns opp ON (s.s_nationkey + 1) % 25 = opp.nk""")
def q_opponent_role_join(spark, sf):
    """J9 + P2: one nation table joined twice, the second time renamed into
    the opponent role."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    ns = (enrich(enrich(li, o, {"l_orderkey": "o_orderkey"}, "inner"), c, {"o_custkey": "c_custkey"}, "inner")
          .groupBy(F.col("c_nationkey").alias("nk"))
          .agg(F.sum("l_extendedprice").alias("revenue"), F.count(F.lit(1)).alias("n_lines")))
    own = opponent_role(ns.drop("n_lines"), {"nk": "s_nationkey", "revenue": "own_revenue"})
    opp = opponent_role(ns, {"nk": "opp_nk", "revenue": "opp_revenue", "n_lines": "opp_lines"})
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey") \
        .withColumn("opp_nk", (F.col("s_nationkey") + 1) % 25)
    out = s.join(own, "s_nationkey", "left").join(opp, "opp_nk", "left")
    return finish(out.select("s_suppkey", "s_nationkey", "own_revenue", "opp_revenue", "opp_lines"))


@register("inner_renamed_keys", """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_inner_renamed_keys(spark, sf):
    """Inner joins on differently named keys."""
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    out = enrich(c, t(spark, sf, "nation"), {"c_nationkey": "n_nationkey"}, "inner")
    out = enrich(out, t(spark, sf, "region"), {"n_regionkey": "r_regionkey"}, "inner")
    return finish(out.select("c_custkey", "n_name", "r_name"))


@register("left_join_one_key", """
SELECT o.o_orderkey, c.c_mktsegment, round(c.c_acctbal, 6) AS c_acctbal
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_left_join_one_key(spark, sf):
    """Left equi-join on one key."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return finish(enrich(o, c, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_mktsegment", "c_acctbal"))


@register("scalar_join", """
SELECT event_id, round(value - (SELECT avg(value) FROM events), 6) AS dev,
       round(value / (SELECT max(value) FROM events), 6) AS rel_max FROM events""")
def q_scalar_join(spark, sf):
    """P11 + A13: ungrouped aggregates reused as constants (scalar subqueries,
    no driver round trip, no cross join)."""
    e = t(spark, sf, "events")
    mean = scalar(e.agg(F.avg("value")))
    mx = scalar(e.agg(F.max("value")))
    return finish(e.select("event_id", (F.col("value") - mean).alias("dev"), (F.col("value") / mx).alias("rel_max")))


# ---------------------------------------------------------------- scalar functions

@register("implied_totals", """
WITH g AS (
  SELECT o_orderkey, o_totalprice / 1000.0 AS total_line, ((o_custkey % 21) - 10) / 2.0 AS spread_line,
         'C' || CAST(o_custkey AS VARCHAR) AS home_team, 'P' || o_orderpriority AS away_team,
         CASE o_orderstatus WHEN 'F' THEN 'C' || CAST(o_custkey AS VARCHAR) WHEN 'O' THEN 'P' || o_orderpriority
              ELSE 'X' END AS posteam,
         CASE o_orderstatus WHEN 'F' THEN 'P' || o_orderpriority WHEN 'O' THEN 'C' || CAST(o_custkey AS VARCHAR)
              ELSE 'X' END AS defteam
  FROM orders)
SELECT o_orderkey, round(total_line / 2 + spread_line / 2, 6) AS home_imptot,
  round(total_line / 2 - spread_line / 2, 6) AS away_imptot,
  round(CASE WHEN posteam = home_team THEN total_line / 2 + spread_line / 2
             WHEN posteam = away_team THEN total_line / 2 - spread_line / 2 END, 6) AS pos_imptot,
  round(CASE WHEN defteam = home_team THEN total_line / 2 + spread_line / 2
             WHEN defteam = away_team THEN total_line / 2 - spread_line / 2 END, 6) AS def_imptot
FROM g""")
def q_implied_totals(spark, sf):
    """X13 + X14: implied team totals from a total and a spread, by role."""
    o = t(spark, sf, "orders")
    home = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    away = F.concat(F.lit("P"), F.col("o_orderpriority"))
    st = F.col("o_orderstatus")
    g = o.select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("total_line"),
                 (((F.col("o_custkey") % 21) - 10) / 2.0).alias("spread_line"),
                 home.alias("home_team"), away.alias("away_team"),
                 F.when(st == "F", home).when(st == "O", away).otherwise("X").alias("posteam"),
                 F.when(st == "F", away).when(st == "O", home).otherwise("X").alias("defteam"))
    h, a = implied_totals("total_line", "spread_line")
    g = g.withColumns({"home_imptot": h, "away_imptot": a})
    return finish(g.select("o_orderkey", "home_imptot", "away_imptot",
                           by_role("posteam", "home_team", "away_team", "home_imptot", "away_imptot").alias("pos_imptot"),
                           by_role("defteam", "home_team", "away_team", "home_imptot", "away_imptot").alias("def_imptot")))


# The priority factor (levels in order, display labels).
PRIO_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIO_LABELS = ["Urgent", "High", "Medium", "Unspecified", "Low"]


@register("factor_labels", """
WITH lv AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY ALL),
rk AS (SELECT o_orderpriority, row_number() OVER (ORDER BY m, o_orderpriority) AS value_rank FROM lv)
SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
       WHEN '4-NOT SPECIFIED' THEN 'Unspecified' WHEN '5-LOW' THEN 'Low' END AS prio,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
       WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS BIGINT) AS prio_ord,
  CAST(6 - CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
       WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS BIGINT) AS prio_rev_ord,
  CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' END AS status,
  rk.value_rank
FROM orders o LEFT JOIN rk USING (o_orderpriority)""")
def q_factor_labels(spark, sf):
    """P7 + P8: factor labels and ordinals (unknown level -> NULL), reversed
    order, and levels reordered by a value (rank on the small level table)."""
    o = t(spark, sf, "orders")
    lv = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    rk = global_row_number(lv, ["m", "o_orderpriority"], "value_rank").drop("m")
    out = o.join(rk, "o_orderpriority", "left")
    ordc = factor_ordinal("o_orderpriority", PRIO_LEVELS)
    return finish(out.select("o_orderkey", factor_label("o_orderpriority", PRIO_LEVELS, PRIO_LABELS).alias("prio"),
                             ordc.alias("prio_ord"), (F.lit(len(PRIO_LEVELS) + 1) - ordc).alias("prio_rev_ord"),
                             factor_label("o_orderstatus", ["F", "O"], ["Filled", "Open"]).alias("status"),
                             "value_rank"))


@register("split_name", """
SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS num,
       substring(split_part(c_name, '#', 2), 6, 4) AS num_tail,
       substring(split_part(c_name, '#', 1), 1, 1) || '.' || split_part(c_name, '#', 2) AS short_name
FROM customer""")
def q_split_name(spark, sf):
    """P6 + X5 + X22: separate a column, substring by position, short name."""
    c = separate(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", ["kind", "num"], "#")
    return finish(c.select("c_custkey", "kind", "num", F.substring("num", 6, 4).alias("num_tail"),
                           initial_name("kind", "num").alias("short_name")))


@register("append_by_name", """
SELECT o_orderkey AS k, round(o_totalprice, 6) AS o_totalprice, 'orders' AS src FROM orders
UNION ALL BY NAME
SELECT c_custkey AS k, round(c_acctbal, 6) AS c_acctbal, 'customer' AS src FROM customer""")
def q_append_by_name(spark, sf):
    """Rows appended by column name; missing columns are NULL."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", F.lit("orders").alias("src"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", F.lit("customer").alias("src"))
    return finish(append(o, c))


# ---------------------------------------------------------------- reshape

@register("pivot_metrics", """
SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS qty_F,
       round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS qty_O
FROM lineitem GROUP BY l_returnflag""")
def q_pivot_metrics(spark, sf):
    """R1 + R4: long -> wide with a name prefix (matrix cast)."""
    li = t(spark, sf, "lineitem")
    return finish(pivot_wider(li, ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity", prefix="qty_",
                              agg="sum"))


@register("pivot_multi", """
SELECT l_returnflag,
  round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 6) AS l_extendedprice_F,
  round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 6) AS l_extendedprice_O,
  round(avg(l_discount) FILTER (WHERE l_linestatus = 'F'), 6) AS l_discount_F,
  round(avg(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS l_discount_O
FROM lineitem GROUP BY l_returnflag""")
def q_pivot_multi(spark, sf):
    """R2: several value columns pivoted, named ``{value}_{level}``."""
    li = t(spark, sf, "lineitem")
    return finish(pivot_wider(li, ["l_returnflag"], "l_linestatus", ["F", "O"], ["l_extendedprice", "l_discount"],
                              agg="mean"))


@register("unpivot_params", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, name, round(value, 6) AS value
FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
      ON l_quantity, l_discount, l_tax INTO NAME name VALUE value)""")
def q_unpivot_params(spark, sf):
    """Wide -> long."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return finish(pivot_longer(li, ["l_quantity", "l_discount", "l_tax"], "name", "value"))


@register("dummy_drop_mode", """
WITH f AS (SELECT o_orderpriority AS level, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
m AS (SELECT level FROM f ORDER BY n DESC, level LIMIT 1),
lv AS (SELECT level FROM f WHERE level NOT IN (SELECT level FROM m))
SELECT o_orderkey, lv.level, CAST(o_orderpriority = lv.level AS BIGINT) AS dummy
FROM orders, lv""")
def q_dummy_drop_mode(spark, sf):
    """0/1 dummies with the most frequent level dropped (long form for
    comparison: one row per order and kept level)."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    d = dummies(o, ["o_orderpriority"]).drop("o_orderpriority")
    cols = [c for c in d.columns if c.startswith("o_orderpriority_")]
    long = pivot_longer(d, cols, "level", "dummy", ids=["o_orderkey"])
    return finish(long.withColumn("level", F.regexp_replace("level", "^o_orderpriority_", "")))


@register("sparse_levels", """
WITH c AS (SELECT o_custkey AS level, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS i FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
p AS (SELECT o_orderpriority AS level, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders
      WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
s AS (SELECT count(*) - 1 AS size FROM c)
SELECT o_orderkey, CASE WHEN c.i > 0 THEN CAST(c.i - 1 AS BIGINT) END AS custkey_at, CASE WHEN p.i > 0 THEN CAST(p.i - 1 + size AS BIGINT) END AS priority_at
FROM orders, s LEFT JOIN c ON o_custkey = c.level LEFT JOIN p ON o_orderpriority = p.level""")
def q_sparse_levels(spark, sf):
    """One-hot codes of any number of levels as sparse positions, the most frequent level dropped."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out, _ = sparse_levels(o, ["o_custkey", "o_orderpriority"])
    levels = t(spark, sf, "orders").agg(F.count_distinct("o_custkey") - 1).scalar()
    first = F.get("hot", F.lit(0))
    has_cust = F.coalesce(first < levels, F.lit(False))
    return finish(out.select("o_orderkey", F.when(has_cust, first).alias("custkey_at"),
                             F.get("hot", F.when(has_cust, 1).otherwise(0)).alias("priority_at")))


@register("design_matrix", """
SELECT o_orderkey, round(o_totalprice, 6) AS x_o_totalprice,
       round(CAST(o_orderstatus = 'F' AS DOUBLE), 6) AS x_filledTRUE, round(CAST(o_custkey AS DOUBLE), 6) AS x_o_custkey
FROM orders""")
def q_design_matrix(spark, sf):
    """Design matrix without intercept; a boolean becomes ``nameTRUE``."""
    from pyspark.ml.functions import vector_to_array

    o = t(spark, sf, "orders").withColumn("filled", F.col("o_orderstatus") == "F")
    dm = design_matrix(o, ["o_totalprice", "filled", "o_custkey"], "features")
    arr = vector_to_array("features")
    return finish(dm.select("o_orderkey", arr[0].alias("x_o_totalprice"), arr[1].alias("x_filledTRUE"),
                            arr[2].alias("x_o_custkey")))


@register("cast_select", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS VARCHAR) AS p_key_text,
       round(p_retailprice, 6) AS p_retailprice, p_brand FROM part""")
def q_cast_select(spark, sf):
    """P1 + P4: select / negative select and a batch type change."""
    p = t(spark, sf, "part").drop("p_name", "p_type")
    p = cast_all(p, ["p_size"], "double").withColumn("p_key_text", F.col("p_partkey").cast("string"))
    return finish(p.select("p_partkey", "p_size", "p_key_text", "p_retailprice", "p_brand"))


@register("keyed_bind", """
WITH s AS (SELECT l_partkey, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc FROM lineitem GROUP BY 1)
SELECT p.p_partkey, stat, round(value, 6) AS value
FROM (UNPIVOT (SELECT p_partkey, s.avg_qty, s.avg_disc FROM part p JOIN s ON p.p_partkey = s.l_partkey)
      ON avg_qty, avg_disc INTO NAME stat VALUE value) p""")
def q_keyed_bind(spark, sf):
    """P10 + U2: column bind done by key (Spark has no positional bind), then
    vectors stacked as rows."""
    s = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"))
    p = t(spark, sf, "part").select("p_partkey").join(s, "p_partkey")
    return finish(stack_rows(p, ["avg_qty", "avg_disc"], "stat", "value", ids=["p_partkey"]))


@register("labels_rounding", """
SELECT o_orderkey,
  'C' || CAST(o_custkey AS VARCHAR) || ': ' || printf('%.1f', round(o_totalprice, 1)) AS lbl,
  round(o_totalprice, -3) AS price_k,
  round(abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)), 6) AS abs_dev,
  CAST(sign(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) AS DOUBLE) AS sign_dev
FROM orders""")
def q_labels_rounding(spark, sf):
    """P9 + X10 + X23: pasted labels, rounding, absolute value and sign."""
    o = t(spark, sf, "orders")
    avg = scalar(o.agg(F.avg("o_totalprice")))
    dev = F.col("o_totalprice") - avg
    return finish(o.select("o_orderkey",
                           label(F.lit("C"), "o_custkey", F.lit(": "),
                                 F.format_string("%.1f", F.round("o_totalprice", 1))).alias("lbl"),
                           F.round("o_totalprice", -3).alias("price_k"), F.abs(dev).alias("abs_dev"),
                           F.signum(dev).alias("sign_dev")))


@register("across_numeric", """
SELECT round(CAST(o_orderkey AS DOUBLE) * 1.5, 4) AS o_orderkey, round(CAST(o_custkey AS DOUBLE) * 1.5, 4) AS o_custkey,
       round(o_totalprice * 1.5, 4) AS o_totalprice, o_orderstatus FROM orders""")
def q_across_numeric(spark, sf):
    """P5: one function applied to every numeric column."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return finish(across_numeric(o, lambda c: F.round(c.cast("double") * 1.5, 4)))


# ---------------------------------------------------------------- filters

@register("predicates", """
SELECT o_orderkey FROM orders
WHERE o_totalprice > 100000 AND coalesce(nullif(o_orderstatus, 'P') IN ('F', 'O'), false)
  AND o_orderdate >= DATE '1996-01-01'
  AND NOT ((month(o_orderdate) = 12 AND year(o_orderdate) > 1996) OR (month(o_orderdate) = 11 AND year(o_orderdate) = 1996))""")
def q_predicates(spark, sf):
    """Conjunctive filter, NULL-proof membership, date range and a
    compound exclusion (NULL predicate drops the row)."""
    o = t(spark, sf, "orders")
    m, y = F.month("o_orderdate"), F.year("o_orderdate")
    cond = ((F.col("o_totalprice") > 100000) & is_in(F.nullif("o_orderstatus", F.lit("P")), ["F", "O"])
            & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("date"))
            & ~(((m == 12) & (y > 1996)) | ((m == 11) & (y == 1996))))
    return finish(o.where(cond).select("o_orderkey"))


@register("group_filter", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 200000)""")
def q_group_filter(spark, sf):
    """keep the rows of groups whose aggregate passes (semi join)."""
    o = t(spark, sf, "orders")
    return finish(keep_groups(o, ["o_custkey"], F.avg("o_totalprice") > 200000).select("o_orderkey", "o_custkey"))


# Event weeks flagged in the weekly order series.
EVENT_WEEKS = ["1996-04-01", "1997-04-07", "1998-04-06", "1999-04-05", "2000-04-03"]


@register("date_flags", """
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT week, n_orders,
  CAST(week IN (DATE '1996-04-01', DATE '1997-04-07', DATE '1998-04-06', DATE '1999-04-05', DATE '2000-04-03') AS BIGINT)
    AS event_flag
FROM w WHERE year(week) > 1995 AND week < DATE '2001-01-01'""")
def q_date_flags(spark, sf):
    """X11 + X12 + F3: weekly dates, event indicator from a date list, date
    window filter."""
    o = t(spark, sf, "orders")
    w = o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n_orders"))
    w = w.where((F.year("week") > 1995) & (F.col("week") < F.lit("2001-01-01").cast("date")))
    return finish(w.withColumn("event_flag", F.col("week").isin([F.lit(d).cast("date") for d in EVENT_WEEKS])
                               .cast("int")))


@register("time_split", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split
FROM orders WHERE year(o_orderdate) <= 2000""")
def q_time_split(spark, sf):
    """time-based train / test split."""
    o = t(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    train, test = time_split(o, "yr", 2000)
    return finish(append(train.select("o_orderkey", F.lit("train").alias("split")),
                         test.select("o_orderkey", F.lit("test").alias("split"))))


# ---------------------------------------------------------------- sorts

@register("ranked_board", """
SELECT c_mktsegment, c_custkey, round(c_acctbal, 6) AS c_acctbal,
       row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank
FROM customer""")
def q_ranked_board(spark, sf):
    """Every row ranked by descending score within its board (a segment
    holds a fifth of all customers: ranked range-partitioned, not in one task)."""
    c = t(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return finish(ranked_board(c, "c_acctbal", ["c_mktsegment"], "rank", tiebreak=["c_custkey"]))


@register("top_n", """
SELECT * FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, round(c_acctbal, 6) AS c_acctbal,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rnk FROM customer)
WHERE rnk <= 3""")
def q_top_n(spark, sf):
    """O3: top 3 per group (partial group-limit before the shuffle)."""
    c = t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return finish(top_n(c, "c_acctbal", 3, ["c_nationkey"], desc=True, tiebreak=["c_custkey"], rank_col="rnk")
                  .withColumn("c_nationkey", F.col("c_nationkey")))


@register("sorted_na_last", """
SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, round(c_acctbal, 6) AS c_acctbal,
  row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey) AS pos
FROM customer""")
def q_sorted_na_last(spark, sf):
    """O1 + N8: multi-key sort with NULLs last in both directions; the
    position is materialised so an order-insensitive compare sees it."""
    c = t(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"),
                                        "c_acctbal")
    order = [F.col("seg").asc_nulls_last(), F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").asc()]
    return finish(global_row_number(c, order, "pos"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("ordinal_sort", """
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                    WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END DESC NULLS LAST, c_custkey) AS pos
FROM customer""")
def q_ordinal_sort(spark, sf):
    """O2: descending sort on a factor (by its ordinal, not its text)."""
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment") \
        .withColumn("_o", factor_ordinal("c_mktsegment", SEGMENTS))
    out = global_row_number(c, [F.col("_o").desc_nulls_last(), F.col("c_custkey").asc()], "pos")
    return finish(out.drop("_o"))


@register("first_row", """
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1""")
def q_first_row(spark, sf):
    """First row of a defined order."""
    return finish(first_row(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]))


# ---------------------------------------------------------------- codes and text

# Code aliases (alias -> canonical code).
ALIASES = [("NATION_1", "N01"), ("NATION_2", "N02"), ("NATION_10", "N10")]


@register("normalise_codes", """
SELECT c_custkey,
  CASE WHEN c_custkey = 5 AND c_acctbal < 5000 THEN 'CORRECTED'
       ELSE coalesce(CASE n_name WHEN 'NATION_1' THEN 'N01' WHEN 'NATION_2' THEN 'N02' WHEN 'NATION_10' THEN 'N10' END,
                     n_name) END AS nation_code
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_normalise_codes(spark, sf):
    """X20 + X21: alias normalisation through a small alias table, then a
    keyed conditional correction."""
    c = enrich(t(spark, sf, "customer"), t(spark, sf, "nation"), {"c_nationkey": "n_nationkey"}, "inner")
    al = spark.createDataFrame(ALIASES, "alias string, code string")
    out = normalise_codes(c, "n_name", al)
    fix = (F.col("c_custkey") == 5) & (F.col("c_acctbal") < 5000)
    return finish(out.select("c_custkey", F.when(fix, F.lit("CORRECTED")).otherwise(F.col("n_name"))
                             .alias("nation_code")))


@register("path_digits", r"""
SELECT page_id,
  TRY_CAST(nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\d+', 0), '') AS BIGINT) AS base_digits,
  TRY_CAST(nullif(regexp_extract(url, '\d+', 0), '') AS BIGINT) AS path_digits
FROM pages""")
def q_path_digits(spark, sf):
    """X4 (+Q9): first digit run of the file's base name, next to the
    first digit run of the whole path."""
    p = t(spark, sf, "pages")
    return finish(p.select("page_id", first_digits("url").alias("base_digits"),
                           F.nullif(F.regexp_extract("url", r"\d+", 0), F.lit("")).try_cast("int")
                           .alias("path_digits")))


WEATHER_TEXT_SQL = """
SELECT event_id, user_id, k, value,
  CASE WHEN k % 13 = 0 THEN NULL ELSE
    (CASE event_type WHEN 'view' THEN 'Cloudy' WHEN 'click' THEN 'Chance of Rain' WHEN 'signup' THEN 'Light Snow'
                     WHEN 'purchase' THEN 'Raining' ELSE 'N/A' END)
    || ' Temp: ' || CAST(k AS VARCHAR) || '° F, Humidity: ' || CAST(k % 50 AS VARCHAR) || '%, Wind: '
    || (CASE WHEN k % 10 = 0 THEN 'Calm' ELSE 'NW ' || CAST(CAST(floor(value) AS BIGINT) % 40 AS VARCHAR) || ' mph' END)
  END AS weather,
  CASE WHEN event_type = 'view' THEN 'dome' WHEN event_type = 'click' THEN 'closed'
       WHEN event_type = 'signup' THEN 'outdoors' WHEN event_type = 'error' THEN 'open' END AS roof
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def weather_text(e):
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    desc = (F.when(et == "view", "Cloudy").when(et == "click", "Chance of Rain").when(et == "signup", "Light Snow")
            .when(et == "purchase", "Raining").otherwise("N/A"))
    wind = F.when(k % 10 == 0, F.lit("Calm")).otherwise(
        F.concat(F.lit("NW "), (F.floor("value").cast("bigint") % 40).cast("string"), F.lit(" mph")))
    txt = F.when(k % 13 != 0, F.concat(desc, F.lit(" Temp: "), k.cast("string"), F.lit("° F, Humidity: "),
                                      (k % 50).cast("string"), F.lit("%, Wind: "), wind))
    roof = (F.when(et == "view", "dome").when(et == "click", "closed").when(et == "signup", "outdoors")
            .when(et == "error", "open"))
    return e.select("event_id", "user_id", k.alias("k"), "value", txt.alias("weather"), roof.alias("roof"))


@register("weather_parse", f"""
WITH w AS ({WEATHER_TEXT_SQL}),
p AS (
  SELECT event_id, roof,
    CASE WHEN regexp_matches(weather, 'Calm') THEN '0'
         WHEN NOT regexp_matches(weather, 'Calm') THEN nullif(regexp_extract(weather, 'Wind:\\D{{0,30}}(\\d{{1,2}})', 1), '') END
      AS wind_weather,
    nullif(regexp_extract(weather, '^([^[:cntrl:]]+) Temp', 1), '') AS d0
  FROM w),
q AS (SELECT *, CASE WHEN NOT coalesce(regexp_matches(d0, '(N|n)/(A|a)'), false) THEN d0 END AS weather_desc FROM p),
r AS (SELECT *, CASE
    WHEN regexp_matches(weather_desc, '(C|c)hance|(C|c)hange|Threat|Expected|likely|Forecasted')
         AND NOT regexp_matches(weather_desc, 'Raining') THEN NULL
    WHEN regexp_matches(weather_desc, '(R|r)ain|(S|s)now|(S|s)hower|(D|d)rizzle|storms') THEN 'yes'
    WHEN weather_desc IS NULL THEN NULL ELSE 'no' END AS precipitation FROM q)
SELECT event_id, weather_desc,
  CASE WHEN precipitation IS NULL AND coalesce(roof IN ('dome', 'closed'), false) THEN 'no' ELSE precipitation END
    AS precipitation,
  round(TRY_CAST(CASE WHEN wind_weather IS NULL AND coalesce(roof IN ('dome', 'closed'), false) THEN '0'
                      ELSE wind_weather END AS DOUBLE), 6) AS wind_weather
FROM r""")
def q_weather_parse(spark, sf):
    """Regex extraction (bounded look-behind, look-ahead),
    alternation detects, numeric cast, closed-roof defaults."""
    w = clean_weather(weather_text(t(spark, sf, "events")))
    return finish(w.select("event_id", "weather_desc", "precipitation", "wind_weather"))


@register("null_fills", f"""
WITH w AS ({WEATHER_TEXT_SQL})
SELECT event_id,
  CAST(CASE WHEN nullif(k, 50) < 10 THEN nullif(k, 50) WHEN NOT (nullif(k, 50) < 10) THEN 10 END AS BIGINT) AS ydstogo,
  round(CASE WHEN nullif(k % 10, 0) IS NULL AND user_id % 5 = 0 THEN 4.36 ELSE CAST(nullif(k % 10, 0) AS DOUBLE) END, 6)
    AS wind_filled,
  CASE WHEN value > 50 THEN 'hi' WHEN NOT (value > 50) THEN 'lo' END AS band,
  CASE WHEN nullif(value, 6.55) > 20 THEN 'hi' WHEN NOT (nullif(value, 6.55) > 20) THEN 'lo' END AS band_na,
  nullif(roof, 'open') AS roof_na
FROM w""")
def q_null_fills(spark, sf):
    """X6, X8, X24, X25, P12 + N1: NULL-propagating conditionals, goal-to-go
    clamp, conditional constant fill, text recoded to NULL."""
    w = weather_text(t(spark, sf, "events"))
    yl = F.nullif("k", F.lit(50))
    wind = F.nullif(F.col("k") % 10, F.lit(0)).cast("double")
    v_na = F.nullif("value", F.lit(6.55))
    return finish(w.select(
        "event_id", goal_to_go(yl, F.lit(10)).alias("ydstogo"),
        fill_value(wind, (F.col("user_id") % 5) == 0, 4.36).alias("wind_filled"),
        if_na(F.col("value") > 50, "hi", "lo").alias("band"),
        if_na(v_na > 20, "hi", "lo").alias("band_na"),
        na_text("roof", "open").alias("roof_na")))
