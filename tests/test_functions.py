from pyspark.sql import functions as F

from sidelines.functions import (as_factor, by_role, extract, first_by, goal_to_go, if_na, implied_totals,
                                 initial_name, is_in, kick_points, label, made_distance, n_distinct_na, play_bucket,
                                 rate, sum0, zone_masks)
from sidelines.functions.text import WEATHER_DESC_PATTERN, WIND_PATTERN, first_digits


def test_if_na_keeps_null_condition(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    out = [r[0] for r in df.select(if_na(F.col("x") > 2, "big", "small")).collect()]
    assert out == ["small", None, "big"]


def test_is_in_never_null(spark):
    df = spark.createDataFrame([("dome",), (None,), ("outdoors",)], "roof string")
    assert [r[0] for r in df.select(is_in("roof", ["dome", "closed"])).collect()] == [True, False, False]


def test_sum0_count_rate_and_distinct_with_null(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, "k1"), ("b", 2, "k1"), ("b", 0, "k2"), ("b", None, None)],
                               "g string, x int, k string")
    out = {r["g"]: r for r in df.groupBy("g").agg(
        sum0("x").alias("s"), rate(F.sum("x"), F.sum(F.lit(0))).alias("r"),
        n_distinct_na("k").alias("nd")).collect()}
    assert out["a"]["s"] == 0 and out["b"]["s"] == 2
    assert out["b"]["r"] is None                      # x / 0 -> NULL, no error
    assert out["a"]["nd"] == 2 and out["b"]["nd"] == 3   # NULL counts as a value


def test_first_by_uses_order_not_position(spark):
    df = spark.createDataFrame([("g", 3, "c"), ("g", 1, "a"), ("g", 2, "b")], "g string, o int, v string")
    assert df.groupBy("g").agg(first_by("v", "o").alias("f")).first()["f"] == "a"


def test_kick_points_rubric(spark):
    data = [("made", 39.0, None), ("made", 40.0, None), ("made", 49.0, None), ("made", 50.0, None),
            ("missed", 45.0, None), ("blocked", 30.0, None), (None, None, "good"), (None, None, "failed"),
            (None, None, "blocked"), (None, None, None)]
    df = spark.createDataFrame(data, "fg string, d double, xp string")
    pts = [r[0] for r in df.select(kick_points("fg", "d", "xp")).collect()]
    assert pts == [3, 4, 4, 5, -1, -1, 1, -1, -1, 999]
    md = [r[0] for r in df.select(made_distance("fg", "xp", "d")).collect()]
    assert md[:4] == [39.0, 40.0, 49.0, 50.0] and md[4] is None


def test_zone_masks_and_bucket(spark):
    df = spark.createDataFrame([(10, 1.0, 25.0, 1, 0), (25, 2.0, -6.0, 0, 1), (50, 3.0, None, None, None)],
                               "y int, e double, g double, rush int, pass int")
    z = zone_masks("y", "e", "g")
    out = df.select(*[v.alias(k) for k, v in z.items()], play_bucket("rush", "pass").alias("b")).collect()
    assert (out[0]["redzone_epa"], out[0]["pinkzone_epa"], out[0]["big_play_20"]) == (1.0, None, 1)
    assert (out[1]["pinkzone_epa"], out[1]["neg_play_5"]) == (2.0, 1)
    assert out[2]["big_play_20"] is None and out[2]["b"] == "other"
    assert [r["b"] for r in out[:2]] == ["rush", "pass"]


def test_implied_totals_swap_by_role(spark):
    df = spark.createDataFrame([("A", "H", "A", 44.0, 3.0), ("H", "H", "A", 44.0, 3.0)],
                               "team string, home string, away string, total double, spread double")
    h, a = implied_totals("total", "spread")
    df = df.withColumns({"h": h, "a": a})
    out = [r[0] for r in df.select(by_role("team", "home", "away", "h", "a")).collect()]
    assert out == [20.5, 23.5]


def test_goal_to_go(spark):
    df = spark.createDataFrame([(5,), (50,), (None,)], "y int")
    assert [r[0] for r in df.select(goal_to_go("y", F.lit(10))).collect()] == [5, 10, None]


def test_weather_regexes(spark):
    df = spark.createDataFrame([("Cloudy Temp: 50° F, Humidity: 60%, Wind: NW 12 mph",),
                                ("Sunny and warm Temp: 70° F, Wind: Calm",), ("Clear",), (None,)], "w string")
    out = df.select(extract("w", WIND_PATTERN).alias("wind"), extract("w", WEATHER_DESC_PATTERN).alias("d")).collect()
    assert out[0]["wind"] == "12" and out[0]["d"] == "Cloudy"
    assert out[1]["wind"] is None and out[1]["d"] == "Sunny and warm"
    assert out[2]["wind"] is None and out[3]["d"] is None


def test_factor_label_and_ordinal(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,), ("a",)], "x string")
    lab, ordc = as_factor("x", ["a", "b"], ["Alpha", "Beta"])
    out = df.select(lab, ordc).collect()
    assert [tuple(r) for r in out] == [("Beta", 2), (None, None), (None, None), ("Alpha", 1)]


def test_label_paste_na_and_names(spark):
    df = spark.createDataFrame([("Justin", "Tucker", None, "/a/b/week12.csv")], "f string, l string, n int, p string")
    r = df.select(label("f", F.lit("-"), "n").alias("t"), initial_name("f", "l").alias("s"),
                  first_digits("p").alias("w")).first()
    assert (r["t"], r["s"], r["w"]) == ("Justin-NA", "J.Tucker", 12)


def test_weather_text_is_searched_once_for_each_pattern(spark):
    """The description is needed in several places of the precipitation class and of its dummies, its search is planned once."""
    from sidelines.functions.text import NA_TEXT, PRECIP_MAYBE
    from sidelines.plans.context import game_context
    games = spark.createDataFrame([("2024-01-03", f"T{u}", f"T{u}") for u in range(40)], "game_id string, posteam string, home_team string")
    plan = game_context(games)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (WEATHER_DESC_PATTERN, WIND_PATTERN, NA_TEXT, PRECIP_MAYBE):
        assert 1 <= plan.count(pattern) <= 2, (pattern, plan.count(pattern))
