"""Schedule, odds and weather of a team-game.

Events carry no schedule, so :func:`schedule` reads one off the team's number
and the date (a fixed mapping, like the adapter's); everything after it is what
a real schedule would go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.domain import by_role, implied_totals
from sidelines.functions.nulls import fill_value, if_na, is_in
from sidelines.functions.text import (NA_TEXT, PRECIP_MAYBE, PRECIP_YES, WEATHER_DESC_PATTERN, WIND_PATTERN, detect, extract)
from sidelines.operators.reshape import dummies

__all__ = ["clean_weather", "schedule", "game_context", "CONTEXT_COLUMNS", "CONTEXT_SQL"]

#: Levels of the figures' factors, the most frequent first (fixed values).
LEVELS = {"roof": ["outdoors", "closed", "dome", "open"], "precipitation": ["no", "unknown", "yes"]}
CONTEXT_COLUMNS = ["pos_imptot", "def_imptot", "pos_imptotdiff", "wind_weather", "roof", "precipitation", "roof_closed", "roof_dome", "roof_open",
                   "precipitation_unknown", "precipitation_yes", "pos_score", "def_score", "fpts_site"]


def clean_weather(df: DataFrame) -> DataFrame:
    """Wind speed and precipitation class from text;
    closed roofs default to no precipitation and no wind.  Branch order is
    kept (Q15): a forecast word without "Raining" is unknown before any rain
    word is tested."""
    w = F.col("weather")
    # a column for each pattern that others use: an expression that stands in several places is searched for in each
    out = df.withColumns({"_wind": extract(w, WIND_PATTERN), "_desc": extract(w, WEATHER_DESC_PATTERN)})
    out = out.withColumns({"wind_weather": if_na(detect(w, "Calm"), F.lit("0"), F.col("_wind")),
                           "weather_desc": F.when(~F.coalesce(detect("_desc", NA_TEXT), F.lit(False)), F.col("_desc"))})
    desc = F.col("weather_desc")
    precip = (F.when(detect(desc, PRECIP_MAYBE) & ~detect(desc, "Raining"), F.lit(None).cast("string"))
              .when(detect(desc, PRECIP_YES), "yes").when(desc.isNull(), F.lit(None).cast("string"))
              .otherwise("no"))
    out = out.withColumn("precipitation", precip).drop("_wind", "_desc")
    closed = is_in("roof", ["dome", "closed"])
    out = out.withColumns({
        "precipitation": fill_value("precipitation", closed, "no"),
        "wind_weather": fill_value("wind_weather", closed, "0")})
    return out.withColumn("wind_weather", F.col("wind_weather").try_cast("double"))


def schedule(games: DataFrame) -> DataFrame:
    """One row per team-game (game_id, posteam, home_team): sides, line, total, roof, weather text, score, published projection."""
    u = F.substring("posteam", 2, 19).cast("bigint")
    day = F.to_date("game_id")
    d, y = F.dayofmonth(day), F.dayofyear(day)
    sky = F.element_at(F.array(*map(F.lit, ["Cloudy", "Chance of Rain", "Light Snow", "N/A"])), ((u + y) % 4 + 1).cast("int"))
    wind = F.when((u + d) % 10 == 0, F.lit("Calm")).otherwise(F.concat(F.lit("NW "), ((u * 5 + d) % 40).cast("string"), F.lit(" mph")))
    roof = F.element_at(F.array(*map(F.lit, ["outdoors"] * 4 + ["dome", "closed", "open"])), (u % 7 + 1).cast("int"))
    return games.select("game_id", "posteam", "home_team").distinct().select(
        "game_id", "posteam", "home_team",
        F.when(F.col("home_team") == F.col("posteam"), F.concat(F.lit("O"), u.cast("string"))).otherwise(F.col("posteam")).alias("away_team"),
        (((u * 7 + d) % 29 - 14) / 2.0).alias("spread_line"), (F.lit(38.0) + (u * 3 + y) % 25 * 0.5).alias("total_line"),
        F.when((u + y) % 11 != 0, roof).alias("roof"),
        F.when((u + d * 2) % 13 != 0, F.concat(sky, F.lit(" Temp: 50° F, Humidity: 40%, Wind: "), wind)).alias("weather"),
        ((u * 11 + y) % 45).alias("home_score"), ((u * 13 + d) % 40).alias("away_score"), ((u * 17 + y) % 120 / 10.0).alias("fpts_site"))


def game_context(games: DataFrame) -> DataFrame:
    """(game_id, posteam, CONTEXT_COLUMNS) of every team-game."""
    s = clean_weather(schedule(games))
    home, away = implied_totals("total_line", "spread_line")
    s = s.withColumns({"_h": home, "_a": away})
    side = ("posteam", "home_team", "away_team")
    s = s.withColumns({
        "pos_imptot": by_role(*side, "_h", "_a"), "def_imptot": by_role(*side, "_a", "_h"),
        "pos_score": by_role(*side, "home_score", "away_score"), "def_score": by_role(*side, "away_score", "home_score"),
        "roof": F.coalesce("roof", F.lit("retractable")), "precipitation": F.coalesce("precipitation", F.lit("unknown"))})
    s = s.withColumn("pos_imptotdiff", F.col("pos_imptot") - F.col("def_imptot"))
    return dummies(s, ["roof", "precipitation"], levels=LEVELS).select("game_id", "posteam", *CONTEXT_COLUMNS)


CONTEXT_SQL = """
cx0 AS (
  SELECT game_id, posteam, home_team = posteam AS home, CAST(substring(posteam, 2) AS BIGINT) AS u, dayofmonth(CAST(game_id AS DATE)) AS d,
         dayofyear(CAST(game_id AS DATE)) AS y FROM (SELECT DISTINCT game_id, posteam, home_team FROM games)),
cx1 AS (
  SELECT *, ((u * 7 + d) % 29 - 14) / 2.0 AS spread, 38.0 + (u * 3 + y) % 25 * 0.5 AS total,
    CASE WHEN (u + y) % 11 <> 0 THEN ['outdoors', 'outdoors', 'outdoors', 'outdoors', 'dome', 'closed', 'open'][u % 7 + 1] END AS roof0,
    CASE WHEN (u + d * 2) % 13 <> 0 THEN ['Cloudy', 'Chance of Rain', 'Light Snow', 'N/A'][(u + y) % 4 + 1] END AS sky,
    CASE WHEN (u + d * 2) % 13 <> 0 THEN CASE WHEN (u + d) % 10 = 0 THEN 0 ELSE (u * 5 + d) % 40 END END AS wind0 FROM cx0),
ctx AS (
  SELECT game_id, posteam, CASE WHEN home THEN total / 2 + spread / 2 ELSE total / 2 - spread / 2 END AS pos_imptot,
    CASE WHEN home THEN total / 2 - spread / 2 ELSE total / 2 + spread / 2 END AS def_imptot,
    CASE WHEN home THEN spread ELSE -spread END AS pos_imptotdiff,
    CAST(coalesce(wind0, CASE WHEN roof0 IN ('dome', 'closed') THEN 0 END) AS DOUBLE) AS wind_weather, coalesce(roof0, 'retractable') AS roof,
    CASE WHEN sky = 'Light Snow' THEN 'yes' WHEN sky = 'Cloudy' THEN 'no' WHEN roof0 IN ('dome', 'closed') THEN 'no' ELSE 'unknown' END AS precipitation,
    CASE WHEN home THEN (u * 11 + y) % 45 ELSE (u * 13 + d) % 40 END AS pos_score, CASE WHEN home THEN (u * 13 + d) % 40 ELSE (u * 11 + y) % 45 END AS def_score,
    (u * 17 + y) % 120 / 10.0 AS fpts_site FROM cx1)"""
