"""Expected-points and scenario-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidelines.functions.domain import goal_to_go
from sidelines.plans.adapter import PLAYS_SQL, plays_from_events
from sidelines.plans.catalog import finish, register
from sidelines.plans.scenario import (SCORE_OF_EVENT, empirical_ep, fit_ep_model, next_score,
                                      scenario, score_ep_model, slice_grid, tooltip)
from sidelines.sources.io import table

# The scenario baseline row and the grid axes.
BASELINE = {"season": 2019, "home_team": "SEA", "posteam": "SEA", "roof": "outdoors",
            "half_seconds_remaining": 900, "yardline_100": 75, "down": 1, "ydstogo": 10,
            "posteam_timeouts_remaining": 3, "defteam_timeouts_remaining": 3}
SECONDS = list(range(1800, -1, -1))
YARDS = list(range(99, -1, -1))
SIDES = ["SEA", "KC"]


STATE = ("yardline_100", "down")


def labelled_plays(spark, sf, columns=STATE):
    """Plays (ids and ``columns``) with their next score."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    p = plays_from_events(table(spark, sf, "events"))
    m = F.create_map(*[F.lit(x) for kv in SCORE_OF_EVENT.items() for x in kv])
    return next_score(p.select("game_id", "posteam", "play_id", F.try_element_at(m, F.col("event_type")).alias("score_type"), *columns))


LABEL_SQL = PLAYS_SQL + """,
lab AS (
  SELECT *, coalesce(first_value(score_type IGNORE NULLS) OVER (PARTITION BY game_id, posteam ORDER BY play_id
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'No_Score') AS next_score
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'Touchdown' WHEN 'signup' THEN 'Field_Goal'
                    WHEN 'error' THEN 'Opp_Touchdown' WHEN 'click' THEN 'Opp_Field_Goal' END AS score_type FROM plays)),
pts AS (SELECT *, CASE next_score WHEN 'Touchdown' THEN 7 WHEN 'Field_Goal' THEN 3 WHEN 'Safety' THEN 2
                    WHEN 'No_Score' THEN 0 WHEN 'Opp_Safety' THEN -2 WHEN 'Opp_Field_Goal' THEN -3
                    WHEN 'Opp_Touchdown' THEN -7 END AS points FROM lab),
ept AS (SELECT yardline_100, down, sum(points) / count(*) AS ep, count(*) AS n_plays FROM pts GROUP BY 1, 2)"""


@register("next_score_label", "WITH " + LABEL_SQL + """
SELECT play_id, next_score FROM lab""")
def q_next_score_label(spark, sf):
    """Next-score class of every play (first score at or after it in the
    same game half, else No_Score)."""
    return finish(labelled_plays(spark, sf, ()).select("play_id", "next_score"))


@register("expected_points", "WITH " + LABEL_SQL + """
SELECT CAST(yardline_100 AS BIGINT) AS yardline_100, CAST(down AS BIGINT) AS down, round(ep, 6) AS ep, n_plays FROM ept""")
def q_expected_points(spark, sf):
    """I8 (empirical model): EP by game state = sum(points x P(next score))."""
    return finish(empirical_ep(labelled_plays(spark, sf), ["yardline_100", "down"]))


GRID_SQL = f"""
g AS (SELECT range AS grid_index, 1800 - (range // 200) AS half_seconds_remaining, 99 - ((range // 2) % 100) AS yardline_100,
             CASE range % 2 WHEN 0 THEN 'SEA' ELSE 'KC' END AS posteam
      FROM range(0, {len(SECONDS) * len(YARDS) * len(SIDES)}))"""


@register("scenario_cross", "WITH " + LABEL_SQL + "," + GRID_SQL + """
SELECT g.grid_index, CAST(2019 AS BIGINT) AS season, 'SEA' AS home_team, 'outdoors' AS roof, g.half_seconds_remaining, g.yardline_100,
       g.posteam, CAST(1 AS BIGINT) AS down, CASE WHEN g.yardline_100 < 10 THEN g.yardline_100 ELSE 10 END AS ydstogo,
       CAST(3 AS BIGINT) AS posteam_timeouts_remaining, CAST(3 AS BIGINT) AS defteam_timeouts_remaining,
       round(e.ep * g.half_seconds_remaining / 1800.0, 6) AS ep
FROM g LEFT JOIN ept e ON e.yardline_100 = g.yardline_100 AND e.down = 1""", headline=True)
def q_scenario_cross(spark, sf):
    """J6 + J7 + I7 + X24: baseline minus the varied columns x the
    1,801 x 100 x 2 grid (360,200 rows, generated from one range, no join),
    goal-to-go clamp, scored with the empirical EP of the plays, scaled by
    the share of the half left."""
    grid = scenario(spark, BASELINE, {"half_seconds_remaining": SECONDS, "yardline_100": YARDS, "posteam": SIDES})
    grid = grid.withColumn("ydstogo", goal_to_go("yardline_100", F.lit(10)))
    ep = empirical_ep(labelled_plays(spark, sf), ["yardline_100", "down"])
    out = grid.join(ep.drop("n_plays"), ["yardline_100", "down"], "left")
    out = out.withColumn("ep", F.col("ep") * F.col("half_seconds_remaining") / 1800.0)
    return finish(out.select("grid_index", "season", "home_team", "roof", "half_seconds_remaining", "yardline_100",
                             "posteam", "down", "ydstogo", "posteam_timeouts_remaining",
                             "defteam_timeouts_remaining", "ep"))


# The downs figure (downs 1-3 at five yard lines).
DOWN_LEVELS, DOWN_LABELS = [1, 2, 3], ["1st down", "2nd down", "3rd down"]
FIVE_YARDS = [10, 25, 50, 75, 90]


@register("grid_slice", "WITH " + LABEL_SQL + """,
g AS (SELECT 1 + (range // 5) AS down, [90, 75, 50, 25, 10][1 + (range % 5)] AS yardline_100 FROM range(0, 15))
SELECT CAST(g.down AS BIGINT) AS down, CAST(g.yardline_100 AS BIGINT) AS yardline_100,
       CASE g.down WHEN 1 THEN '1st down' WHEN 2 THEN '2nd down' WHEN 3 THEN '3rd down' END AS down_label,
       CAST(g.down AS BIGINT) AS down_ord, round(e.ep, 6) AS ep
FROM g LEFT JOIN ept e ON e.yardline_100 = g.yardline_100 AND e.down = g.down""")
def q_grid_slice(spark, sf):
    """The downs figure slice: downs x five yard lines, factor labels,
    scored with the empirical EP."""
    grid = scenario(spark, {}, {"down": DOWN_LEVELS, "yardline_100": sorted(FIVE_YARDS, reverse=True)}, None)
    ep = empirical_ep(labelled_plays(spark, sf), ["yardline_100", "down"]).drop("n_plays")
    out = slice_grid(grid.join(ep, ["yardline_100", "down"], "left"), {"down": DOWN_LEVELS},
                     {"down": (DOWN_LEVELS, DOWN_LABELS)})
    return finish(out.select("down", "yardline_100", "down_label", "down_ord", "ep"))


@register("tooltip", "WITH " + LABEL_SQL + """
SELECT CAST(yardline_100 AS BIGINT) AS yardline_100,
       'Yardline: ' || CAST(yardline_100 AS VARCHAR) || '<br>' || 'Down: ' || CAST(down AS VARCHAR) || '<br>'
       || 'EP: ' || printf('%.2f', round(ep, 2)) AS text
FROM ept WHERE yardline_100 IN (10, 25, 50, 75, 90)""")
def q_tooltip(spark, sf):
    """Hover text per scored state."""
    ep = empirical_ep(labelled_plays(spark, sf), ["yardline_100", "down"])
    ep = slice_grid(ep, {"yardline_100": FIVE_YARDS})
    txt = tooltip([("Yardline", F.col("yardline_100")), ("Down", F.col("down")),
                   ("EP", F.format_string("%.2f", F.round("ep", 2)))])
    return finish(ep.select("yardline_100", txt.alias("text")))


@register("ep_model")
def q_ep_model(spark, sf):
    """I8 (model): multinomial logistic regression of the next score on the
    play state, then EP = sum(points x probability) over the downs x yards
    slice.  Rows-only (model fit)."""
    lab = labelled_plays(spark, sf).withColumn("ydstogo", goal_to_go("yardline_100", F.lit(10)))
    feats = ["yardline_100", "down", "ydstogo"]
    model, labels = fit_ep_model(lab.select(*feats, "next_score"), feats)
    grid = scenario(spark, {"ydstogo": 10}, {"down": DOWN_LEVELS, "yardline_100": YARDS}, None)
    grid = grid.withColumn("ydstogo", goal_to_go("yardline_100", F.lit(10)))
    return finish(score_ep_model(model, labels, grid).select("down", "yardline_100", "ep"))



# ---------------------------------------------------------------- figure grids

# Axes, levels and labels of the figures.
CLOCKS, TIMEOUTS = [900, 450, 240, 120], [3, 2, 1, 0]
ERAS = [2001, 2005, 2013, 2017, 2022]
ERA_LABELS = ["1999-2001", "2002-2005", "2006-2013", "2014-2017", "2018-present"]
ROOFS = ["outdoors", "retractable", "dome"]


def game_states(spark, sf):
    """Labelled plays with the predictors of the figures.  Events carry no
    clock, timeouts, roof or era; they are read off the event (fixed mapping):
    seconds left = 1800 - second of the day modulo 1801, timeouts = 3 - k div 25
    and event id modulo 4, roof and era by the team's number and the day of the year."""
    p = labelled_plays(spark, sf, (*STATE, "ts", "user_id", "home_team"))
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    left = F.lit(1800) - sec % 1801
    return p.withColumns({
        "half_seconds_remaining": left,
        "clock": F.when(left >= 675, 900).when(left >= 345, 450).when(left >= 180, 240).otherwise(120),
        "posteam_timeouts_remaining": F.lit(3) - F.floor(F.col("yardline_100") / 25).cast("int"),
        "defteam_timeouts_remaining": (F.col("play_id") % 4).cast("int"),
        "roof": F.element_at(F.array(*map(F.lit, ROOFS)), (F.col("user_id") % 3 + 1).cast("int")),
        "era": F.element_at(F.array(*map(F.lit, ERAS)), (F.dayofyear("ts") % 5 + 1).cast("int")),
        "side": F.when(F.col("home_team") == F.col("posteam"), "home").otherwise("away"),
    })


STATES_SQL = LABEL_SQL + """,
st0 AS (SELECT *, 1800 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 1801 AS half_seconds_remaining FROM pts),
st AS (SELECT *, CASE WHEN half_seconds_remaining >= 675 THEN 900 WHEN half_seconds_remaining >= 345 THEN 450
                      WHEN half_seconds_remaining >= 180 THEN 240 ELSE 120 END AS clock,
              3 - yardline_100 // 25 AS pto, play_id % 4 AS dto, ['outdoors', 'retractable', 'dome'][user_id % 3 + 1] AS roof,
              [2001, 2005, 2013, 2017, 2022][dayofyear(ts) % 5 + 1] AS era,
              CASE WHEN home_team = posteam THEN 'home' ELSE 'away' END AS side FROM st0)"""


def timeouts_grid(spark):
    return scenario(spark, {}, {"clock": CLOCKS, "posteam_timeouts_remaining": TIMEOUTS, "defteam_timeouts_remaining": TIMEOUTS}, None)


def eras_grid(spark):
    return scenario(spark, {}, {"era": ERAS, "yardline_100": YARDS, "side": ["home", "away"]}, None)


def roofs_grid(spark):
    return scenario(spark, {}, {"roof": ROOFS, "side": ["home", "away"], "yardline_100": sorted(FIVE_YARDS, reverse=True)}, None)


def home_grid(spark):
    return scenario(spark, {"side": "home"}, {"half_seconds_remaining": SECONDS, "yardline_100": YARDS}, None)


def _scored(grid, states, keys):
    return grid.join(empirical_ep(states, keys), keys, "left").withColumn("n_plays", F.coalesce("n_plays", F.lit(0)))


@register("grid_timeouts", "WITH " + STATES_SQL + """,
e AS (SELECT clock, pto, dto, sum(points) / count(*) AS ep, count(*) AS n FROM st GROUP BY 1, 2, 3),
g AS (SELECT [900, 450, 240, 120][1 + range // 16] AS clock, 3 - (range // 4) % 4 AS pto, 3 - range % 4 AS dto FROM range(0, 64))
SELECT CAST(clock AS BIGINT) AS clock, clock || 's' AS clock_label, CAST(pto AS BIGINT) AS posteam_timeouts_remaining,
       CAST(dto AS BIGINT) AS defteam_timeouts_remaining, round(ep, 6) AS ep, coalesce(n, 0) AS n_plays
FROM g LEFT JOIN e USING (clock, pto, dto)""")
def q_grid_timeouts(spark, sf):
    """The timeouts figure: clock x offence's x defence's timeouts left, scored with the empirical EP."""
    keys = ["clock", "posteam_timeouts_remaining", "defteam_timeouts_remaining"]
    out = _scored(timeouts_grid(spark), game_states(spark, sf), keys)
    return finish(out.select("clock", F.concat(F.col("clock").cast("string"), F.lit("s")).alias("clock_label"), *keys[1:], "ep", "n_plays"))


@register("grid_eras", "WITH " + STATES_SQL + """,
e AS (SELECT era, yardline_100, side, sum(points) / count(*) AS ep, count(*) AS n FROM st GROUP BY 1, 2, 3),
g AS (SELECT [2001, 2005, 2013, 2017, 2022][1 + range // 200] AS era, 99 - (range // 2) % 100 AS yardline_100,
             CASE range % 2 WHEN 0 THEN 'home' ELSE 'away' END AS side FROM range(0, 1000))
SELECT CAST(era AS BIGINT) AS era, CASE era WHEN 2001 THEN '1999-2001' WHEN 2005 THEN '2002-2005' WHEN 2013 THEN '2006-2013'
       WHEN 2017 THEN '2014-2017' ELSE '2018-present' END AS era_label, CAST(yardline_100 AS BIGINT) AS yardline_100, side,
       CASE WHEN yardline_100 < 10 THEN CAST(yardline_100 AS BIGINT) ELSE 10 END AS ydstogo, round(ep, 6) AS ep, coalesce(n, 0) AS n_plays
FROM g LEFT JOIN e USING (era, yardline_100, side)""")
def q_grid_eras(spark, sf):
    """I10 + X24: the eras figure: era x yard line x side, goal-to-go clamp, factor labels."""
    out = _scored(eras_grid(spark), game_states(spark, sf), ["era", "yardline_100", "side"])
    out = slice_grid(out.withColumn("ydstogo", goal_to_go("yardline_100", F.lit(10))), {"era": ERAS}, {"era": (ERAS, ERA_LABELS)})
    return finish(out.select("era", "era_label", "yardline_100", "side", "ydstogo", "ep", "n_plays"))


@register("grid_roofs", "WITH " + STATES_SQL + """,
e AS (SELECT roof, yardline_100, side, sum(points) / count(*) AS ep, count(*) AS n FROM st GROUP BY 1, 2, 3),
g AS (SELECT ['outdoors', 'retractable', 'dome'][1 + range // 10] AS roof, CASE (range // 5) % 2 WHEN 0 THEN 'home' ELSE 'away' END AS side,
             [90, 75, 50, 25, 10][1 + range % 5] AS yardline_100 FROM range(0, 30))
SELECT roof, CAST(CASE roof WHEN 'dome' THEN 1 WHEN 'retractable' THEN 2 ELSE 3 END AS BIGINT) AS roof_ord, side,
       CAST(yardline_100 AS BIGINT) AS yardline_100, round(ep, 6) AS ep, coalesce(n, 0) AS n_plays
FROM g LEFT JOIN e USING (roof, yardline_100, side)""")
def q_grid_roofs(spark, sf):
    """The roofs figure: roof x side x five yard lines."""
    out = _scored(roofs_grid(spark), game_states(spark, sf), ["roof", "yardline_100", "side"])
    out = slice_grid(out, {"roof": ROOFS}, {"roof": (["dome", "retractable", "outdoors"],) * 2})
    return finish(out.select("roof", "roof_ord", "side", "yardline_100", "ep", "n_plays"))


@register("grid_home", "WITH " + STATES_SQL + f""",
e AS (SELECT half_seconds_remaining // 60 AS minute, yardline_100, sum(points) / count(*) AS ep, count(*) AS n FROM st WHERE side = 'home' GROUP BY 1, 2),
g AS (SELECT 1800 - range // 100 AS half_seconds_remaining, 99 - range % 100 AS yardline_100 FROM range(0, {len(SECONDS) * len(YARDS)}))
SELECT CAST(g.half_seconds_remaining AS BIGINT) AS half_seconds_remaining, CAST(g.yardline_100 AS BIGINT) AS yardline_100,
       round(ep, 6) AS ep, coalesce(n, 0) AS n_plays
FROM g LEFT JOIN e ON e.yardline_100 = g.yardline_100 AND e.minute = g.half_seconds_remaining // 60""")
def q_grid_home(spark, sf):
    """The home-only surface: every second of the half x yard line, scored with the home plays of that minute."""
    minute = F.floor(F.col("half_seconds_remaining") / 60)
    states = game_states(spark, sf).where("side = 'home'").withColumn("minute", minute)
    out = _scored(home_grid(spark).withColumn("minute", minute), states, ["minute", "yardline_100"])
    return finish(out.select("half_seconds_remaining", "yardline_100", "ep", "n_plays"))


@register("ep_model_grids")
def q_ep_model_grids(spark, sf):
    """I8 + I10 (model): multinomial logistic regression on clock, field
    position, down, side, timeouts, roof and era, scored on the timeouts, eras,
    roofs and home-only grids.  Rows-only (model fit)."""
    feats = ["half_seconds_remaining", "yardline_100", "down", "ydstogo", "home", "posteam_timeouts_remaining",
             "defteam_timeouts_remaining", "dome", "retractable", *[f"era{i}" for i in range(1, len(ERAS))]]

    def predictors(df):
        base = {"half_seconds_remaining": 900, "yardline_100": 75, "down": 1, "side": "home", "posteam_timeouts_remaining": 3,
                "defteam_timeouts_remaining": 3, "roof": "outdoors", "era": 2022}
        df = df.withColumns({c: F.lit(v) for c, v in base.items() if c not in df.columns})
        return df.withColumns({
            "ydstogo": goal_to_go("yardline_100", F.lit(10)), "home": (F.col("side") == "home").cast("int"),
            **{r: (F.col("roof") == r).cast("int") for r in ROOFS[1:]},
            **{f"era{i}": (F.col("era") == e).cast("int") for i, e in enumerate(ERAS) if i}})

    model, labels = fit_ep_model(predictors(game_states(spark, sf)).select(*feats, "next_score"), feats)
    grids = {"timeouts": timeouts_grid(spark).withColumn("half_seconds_remaining", F.col("clock")), "eras": eras_grid(spark),
             "roofs": roofs_grid(spark), "home": home_grid(spark)}
    out = None
    for name, g in grids.items():
        s = score_ep_model(model, labels, predictors(g)).select(F.lit(name).alias("figure"), *feats, "ep")
        out = s if out is None else out.unionByName(s)
    return finish(out)
