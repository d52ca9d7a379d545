"""Impact of an event on weekly series against a counterfactual.

A series is a bounded sequence of weeks, so per-series windows are safe;
scale comes from the number of series and of posterior draws, and every step
below is a grouped aggregate or an equi-join over (series, draw, week).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.factor import factor_ordinal
from sidelines.functions.nulls import pct_diff
from sidelines.operators.reshape import append, mask_between, pivot_wider
from sidelines.operators.windows import row_index

__all__ = ["weekly_series", "event_window", "bootstrap_draws", "band", "impact_summary", "relative_lift",
           "impact_table", "STAT_LEVELS"]

# Report row order of the impact table.
STAT_LEVELS = ["Predicted", "Actual", "Relative Increase (%)"]


def weekly_series(df: DataFrame, series: str, ts: str, value: str, scale: float = 1000.0,
                  event_weeks: Sequence[str] = ()) -> DataFrame:
    """Weekly sums per series with an event indicator."""
    w = F.to_date(F.date_trunc("week", ts))
    out = df.groupBy(F.col(series).alias("series_id"), w.alias("week")).agg((F.sum(value) / scale).alias("y"))
    return out.withColumn("event_flag", F.col("week").isin([F.lit(d).cast("date") for d in event_weeks]).cast("int"))


def event_window(df: DataFrame, keys: Sequence[str], time: str, y: str, pre_end: int, post_end: int | None = None) -> DataFrame:
    """I1 + P13: index the series, mark pre/post and mask the outcome in the
    post period (``y_actual`` keeps it).  The post period runs to the end of
    each series unless ``post_end`` names the event's last week."""
    idx = row_index(df, keys, [time], "idx")
    if post_end is not None:
        idx = idx.where(F.col("idx") <= post_end)
    return idx.withColumns({
        "phase": F.when(F.col("idx") <= pre_end, "pre").otherwise("post"),
        "y_actual": F.col(y),
        y: mask_between(y, "idx", pre_end + 1, (1 << 31) - 1 if post_end is None else post_end),
    })


def bootstrap_draws(win: DataFrame, keys: Sequence[str], pre_end: int, draws: int, seed: int = 7,
                    y: str = "y_actual") -> DataFrame:
    """Deterministic counterfactual draws, a bootstrap of the pre-period: in
    draw d the prediction of post week t is the pre-period value at an index
    taken from the MD5 of "seed:d:t", which other engines compute alike, so
    draws differ from one another and do not repeat.  Output (keys, draw, idx, y_hat)."""
    post = win.where(F.col("phase") == "post").select(*keys, "idx") \
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("idx").cast("string")).cast("binary"))
    post = post.withColumn("src", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % pre_end + 1)
    pre = win.where(F.col("phase") == "pre").select(*keys, F.col("idx").alias("src"), F.col(y).alias("y_hat"))
    return post.join(pre, [*keys, "src"]).drop("src")


def band(draws: DataFrame, keys: Sequence[str], t: str = "idx", alpha: float = 0.05) -> DataFrame:
    """Mean prediction and central (1 - alpha) band per time point.
    Groups hold one value per draw, so exact percentiles are bounded."""
    return draws.groupBy(*keys, t).agg(
        F.avg("y_hat").alias("pred"), F.percentile("y_hat", alpha / 2).alias("pred_lo"),
        F.percentile("y_hat", 1 - alpha / 2).alias("pred_hi"))


def impact_summary(draws: DataFrame, win: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """I4: average and cumulative actual vs predicted (mean and percentile
    bounds over the per-draw post-period average / sum)."""
    act = win.where(F.col("phase") == "post").groupBy(*keys).agg(
        F.avg("y_actual").alias("actual_avg"), F.sum("y_actual").alias("actual_sum"))
    per = draws.groupBy(*keys, "draw").agg(F.avg("y_hat").alias("a"), F.sum("y_hat").alias("s"))
    lo, hi = alpha / 2, 1 - alpha / 2
    pred = per.groupBy(*keys).agg(
        F.avg("a").alias("pred_avg"), F.percentile("a", lo).alias("pred_avg_lo"), F.percentile("a", hi).alias("pred_avg_hi"),
        F.avg("s").alias("pred_sum"), F.percentile("s", lo).alias("pred_sum_lo"), F.percentile("s", hi).alias("pred_sum_hi"))
    return act.join(pred, list(keys))


def relative_lift(summary: DataFrame) -> DataFrame:
    """Relative increase in percent; the lower bound divides by the upper
    prediction and vice versa."""
    out = {}
    for a in ("avg", "sum"):
        out[f"lift_{a}"] = pct_diff(f"actual_{a}", f"pred_{a}")
        out[f"lift_{a}_lo"] = pct_diff(f"actual_{a}", f"pred_{a}_hi")
        out[f"lift_{a}_hi"] = pct_diff(f"actual_{a}", f"pred_{a}_lo")
    return summary.withColumns(out)


def _r_text(c):
    """Number as R prints a value rounded to 1 place: ``12`` or ``12.5``."""
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(F.format_string("%.1f", c)))


def impact_table(lifted: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """One row per (series, stat) with value and "(lo, hi)" interval text
    per aggregate, rounded, pivoted by aggregate and ordered by the stat factor."""
    parts = []
    for a in ("avg", "sum"):
        parts.append(lifted.select(*keys, F.lit("Actual").alias("stat"), F.lit(a).alias("agg"),
                                   F.col(f"actual_{a}").alias("value"), F.lit(None).cast("double").alias("lcl"),
                                   F.lit(None).cast("double").alias("ucl")))
        parts.append(lifted.select(*keys, F.lit("Predicted").alias("stat"), F.lit(a).alias("agg"),
                                   F.col(f"pred_{a}").alias("value"), F.col(f"pred_{a}_lo").alias("lcl"),
                                   F.col(f"pred_{a}_hi").alias("ucl")))
        parts.append(lifted.select(*keys, F.lit("Relative Increase (%)").alias("stat"), F.lit(a).alias("agg"),
                                   F.col(f"lift_{a}").alias("value"), F.col(f"lift_{a}_lo").alias("lcl"),
                                   F.col(f"lift_{a}_hi").alias("ucl")))
    long = append(*parts).withColumns({c: F.round(c, digits) for c in ("value", "lcl", "ucl")})
    txt = F.concat(F.lit("("), F.coalesce(_r_text(F.col("lcl")), F.lit("NA")), F.lit(", "),
                   F.coalesce(_r_text(F.col("ucl")), F.lit("NA")), F.lit(")"))
    long = long.withColumn("interval", F.nullif(txt, F.lit("(NA, NA)")))
    wide = pivot_wider(long, [*keys, "stat"], "agg", ["avg", "sum"], ["value", "interval"])
    return wide.withColumn("stat_ord", factor_ordinal("stat", STAT_LEVELS))
