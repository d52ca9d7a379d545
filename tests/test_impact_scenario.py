import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sidelines.ml.bsts import fit_counterfactual
from sidelines.plans.impact import event_window, impact_summary, relative_lift
from sidelines.plans.scenario import empirical_ep, next_score


def _series(spark, lift):
    rng = np.random.default_rng(5)
    start = dt.date(2022, 1, 2)
    rows = []
    for sid, l in (("planted", lift), ("flat", 0.0)):
        for t in range(85):
            y = 50 + 10 * np.sin(2 * np.pi * t / 52) + rng.normal(0, 1.0) + (l if t >= 74 else 0.0)
            rows.append((sid, start + dt.timedelta(weeks=t), float(y), 0))
    return spark.createDataFrame(rows, "series_id string, week date, y double, event_flag int")


def test_counterfactual_finds_planted_lift_and_covers_zero(spark):
    w = event_window(_series(spark, 15.0), ["series_id"], "week", "y", 74, 85)
    assert w.where("phase = 'post' and y is not null").count() == 0
    draws = fit_counterfactual(w, ["series_id"], "idx", "y", ["event_flag"], pre_end=74, draws=300, seed=42)
    s = {r["series_id"]: r for r in relative_lift(impact_summary(draws, w, ["series_id"])).collect()}
    assert s["planted"]["lift_avg_lo"] > 0                                   # lift detected
    assert s["flat"]["lift_avg_lo"] < 0 < s["flat"]["lift_avg_hi"]          # no effect: interval covers 0


def test_next_score_and_ep_range(spark):
    plays = spark.createDataFrame([
        ("g", "T", 1, None, 20), ("g", "T", 2, "Field_Goal", 25), ("g", "T", 3, None, 60), ("g", "T", 4, None, 70),
        ("h", "T", 1, "Opp_Touchdown", 20)], "game_id string, posteam string, play_id int, score_type string, yardline_100 int")
    lab = {r["play_id"] if r["game_id"] == "g" else -1: r["next_score"] for r in next_score(plays).collect()}
    assert lab == {1: "Field_Goal", 2: "Field_Goal", 3: "No_Score", 4: "No_Score", -1: "Opp_Touchdown"}
    ep = empirical_ep(next_score(plays), ["yardline_100"]).collect()
    assert all(-7 <= r["ep"] <= 7 for r in ep)


def test_next_score_equals_a_window(spark):
    from pyspark.sql import Window
    from sidelines.plans.adapter import plays_from_events
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    p = plays_from_events(ev).withColumn(
        "score_type", F.when(F.col("event_type") == "purchase", "Touchdown").when(F.col("event_type") == "signup",
                                                                                   "Field_Goal"))
    a = {r["play_id"]: r["next_score"] for r in next_score(p).select("play_id", "next_score").collect()}
    w = Window.partitionBy("game_id", "posteam").orderBy("play_id").rowsBetween(0, Window.unboundedFollowing)
    b = p.select("play_id", F.coalesce(F.first("score_type", ignorenulls=True).over(w), F.lit("No_Score")).alias("s"))
    assert a == dict(b.collect()) and len(a) == ev.count()
