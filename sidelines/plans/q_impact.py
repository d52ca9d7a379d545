"""Impact-analysis queries over weekly order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidelines.ml.bsts import fit_counterfactual
from sidelines.plans.catalog import finish, register
from sidelines.plans.impact import (band, bootstrap_draws, event_window, impact_summary, impact_table,
                                    relative_lift, weekly_series)
from sidelines.sources.io import table

PRE_END, DRAWS, SEED = 300, 1000, 7
KEYS = ["series_id"]


def window(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ws = weekly_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return event_window(ws, KEYS, "week", "y", PRE_END)


WIN_SQL = f"""
ws AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
              sum(o_totalprice) / 1000.0 AS y FROM orders GROUP BY 1, 2),
win AS (
  SELECT series_id, week, idx, CASE WHEN idx <= {PRE_END} THEN 'pre' ELSE 'post' END AS phase, y AS y_actual,
         CASE WHEN idx <= {PRE_END} THEN y END AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) AS idx FROM ws)),
post AS (SELECT series_id, idx, d.draw FROM win CROSS JOIN range(1, {DRAWS + 1}) AS d(draw) WHERE phase = 'post'),
dr AS (SELECT p.series_id, p.draw, p.idx, w.y_actual AS y_hat FROM post p JOIN win w
       ON p.series_id = w.series_id AND w.phase = 'pre' AND w.idx = ('0x' || substr(md5('{SEED}:' || p.draw || ':' || p.idx), 1, 8))::BIGINT % {PRE_END} + 1)"""

SUMMARY_SQL = WIN_SQL + """,
act AS (SELECT series_id, avg(y_actual) AS actual_avg, sum(y_actual) AS actual_sum FROM win WHERE phase = 'post'
        GROUP BY 1),
per AS (SELECT series_id, draw, avg(y_hat) AS a, sum(y_hat) AS s FROM dr GROUP BY 1, 2),
pred AS (SELECT series_id, avg(a) AS pred_avg, quantile_cont(a, 0.025) AS pred_avg_lo, quantile_cont(a, 0.975) AS pred_avg_hi,
                avg(s) AS pred_sum, quantile_cont(s, 0.025) AS pred_sum_lo, quantile_cont(s, 0.975) AS pred_sum_hi
         FROM per GROUP BY 1),
sm AS (SELECT act.*, pred.* EXCLUDE (series_id),
  100 * (actual_avg / nullif(pred_avg, 0) - 1) AS lift_avg, 100 * (actual_avg / nullif(pred_avg_hi, 0) - 1) AS lift_avg_lo,
  100 * (actual_avg / nullif(pred_avg_lo, 0) - 1) AS lift_avg_hi,
  100 * (actual_sum / nullif(pred_sum, 0) - 1) AS lift_sum, 100 * (actual_sum / nullif(pred_sum_hi, 0) - 1) AS lift_sum_lo,
  100 * (actual_sum / nullif(pred_sum_lo, 0) - 1) AS lift_sum_hi
  FROM act JOIN pred USING (series_id))"""


@register("event_window", "WITH" + WIN_SQL + """
SELECT series_id, week, idx, phase, round(y_actual, 6) AS y_actual, round(y, 6) AS y FROM win""")
def q_event_window(spark, sf):
    """I1 + P13 + P3 + W11: indexed weekly series, pre/post phases, masked outcome."""
    return finish(window(spark, sf).select("series_id", "week", "idx", "phase", "y_actual", "y"))


@register("impact_band", "WITH" + WIN_SQL + """
SELECT series_id, idx, round(round(avg(y_hat), 9), 6) AS pred, round(quantile_cont(y_hat, 0.025), 6) AS pred_lo,
       round(quantile_cont(y_hat, 0.975), 6) AS pred_hi FROM dr GROUP BY 1, 2""")
def q_impact_band(spark, sf):
    """Counterfactual mean and 95% band per post week (deterministic
    bootstrap draws, so the band is reproducible in SQL)."""
    w = window(spark, sf)
    # a mean of 1,000 prices ends in a 5 at the seventh place often enough: take off the noise of summing first
    return finish(band(bootstrap_draws(w, KEYS, PRE_END, DRAWS, SEED), KEYS).withColumn("pred", F.round("pred", 9)))


@register("impact_summary", "WITH" + SUMMARY_SQL + """
SELECT series_id, """ + ", ".join(f"round({c}, 6) AS {c}" for c in [
    "actual_avg", "actual_sum", "pred_avg", "pred_avg_lo", "pred_avg_hi", "pred_sum", "pred_sum_lo", "pred_sum_hi",
    "lift_avg", "lift_avg_lo", "lift_avg_hi", "lift_sum", "lift_sum_lo", "lift_sum_hi"]) + " FROM sm")
def q_impact_summary(spark, sf):
    """I4 + I5 (+X18): average / cumulative actual vs predicted with bounds,
    and the relative lift with swapped bounds."""
    w = window(spark, sf)
    s = relative_lift(impact_summary(bootstrap_draws(w, KEYS, PRE_END, DRAWS, SEED), w, KEYS))
    return finish(s)


def _txt(c):
    return f"CASE WHEN {c} = floor({c}) THEN printf('%.0f', {c}) ELSE printf('%.1f', {c}) END"


IMPACT_TABLE_SQL = "WITH" + SUMMARY_SQL + """,
lng AS (
  SELECT series_id, 'Actual' AS stat, 'avg' AS agg, actual_avg AS value, NULL::DOUBLE AS lcl, NULL::DOUBLE AS ucl FROM sm
  UNION ALL SELECT series_id, 'Predicted', 'avg', pred_avg, pred_avg_lo, pred_avg_hi FROM sm
  UNION ALL SELECT series_id, 'Relative Increase (%)', 'avg', lift_avg, lift_avg_lo, lift_avg_hi FROM sm
  UNION ALL SELECT series_id, 'Actual', 'sum', actual_sum, NULL, NULL FROM sm
  UNION ALL SELECT series_id, 'Predicted', 'sum', pred_sum, pred_sum_lo, pred_sum_hi FROM sm
  UNION ALL SELECT series_id, 'Relative Increase (%)', 'sum', lift_sum, lift_sum_lo, lift_sum_hi FROM sm),
rd AS (SELECT series_id, stat, agg, round(value, 1) AS value, round(lcl, 1) AS lcl, round(ucl, 1) AS ucl FROM lng),
tx AS (SELECT *, nullif('(' || coalesce(""" + _txt("lcl") + """, 'NA') || ', ' || coalesce(""" + _txt("ucl") + """, 'NA') || ')',
                        '(NA, NA)') AS interval FROM rd)
SELECT series_id, stat,
  round(max(value) FILTER (WHERE agg = 'avg'), 6) AS value_avg, round(max(value) FILTER (WHERE agg = 'sum'), 6) AS value_sum,
  max(interval) FILTER (WHERE agg = 'avg') AS interval_avg, max(interval) FILTER (WHERE agg = 'sum') AS interval_sum,
  CAST(CASE stat WHEN 'Predicted' THEN 1 WHEN 'Actual' THEN 2 WHEN 'Relative Increase (%)' THEN 3 END AS BIGINT) AS stat_ord
FROM tx GROUP BY series_id, stat"""


@register("impact_table", IMPACT_TABLE_SQL)
def q_impact_table(spark, sf):
    """Report table: stacked stats, rounded, CI text, pivoted by aggregate,
    ordered by the stat factor."""
    w = window(spark, sf)
    s = relative_lift(impact_summary(bootstrap_draws(w, KEYS, PRE_END, DRAWS, SEED), w, KEYS))
    return finish(impact_table(s, KEYS))


@register("bsts_fit")
def q_bsts_fit(spark, sf):
    """I2 (+I3-I5 on its draws): Bayesian structural counterfactual per series
    (trend + 52-week harmonics + event regressor, AR(1) errors), 1,000 exact
    conjugate posterior draws with a fixed seed, summarised as the impact
    summary with relative lift.  Not SQL-expressible (sampler)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from sidelines.plans.q_tables import EVENT_WEEKS
    ws = weekly_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice",
                       event_weeks=EVENT_WEEKS)
    w = event_window(ws, KEYS, "week", "y", PRE_END)
    draws = fit_counterfactual(w, KEYS, "idx", "y", ["event_flag"], pre_end=PRE_END, nseasons=52,
                               draws=1000, seed=42)
    return finish(relative_lift(impact_summary(draws, w, KEYS)))

