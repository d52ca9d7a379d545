"""Adapter from the generic ``events`` table to the play-level schema.

The test tables carry no football plays, so events stand in for them
(mapping fixed here once; every play-level query reads it):

* ``season``  = Monday of the event's week (DATE), ``game_id`` = event date text
* ``posteam`` = ``T<user_id>``; the team is at home on days where
  day-of-month + user_id is even (``home_team`` = posteam), else away
* purchase -> FG made; error -> FG missed (blocked when k >= 90);
  signup -> XP good; click -> XP failed (blocked when k >= 90); view -> no kick
* ``yardline_100`` = props.k, ``kick_distance`` = k + 17 on kick rows,
  ``epa`` = value, ``play_id`` = event_id (unique order key)
* ``defteam`` = ``T<user_id xor 1>`` (users paired as opponents);
  rush = view/click, pass = purchase/signup, ``yards_gained`` = value - 35,
  ``success`` = value >= 40, ``down`` = floor(value) % 4 + 1, ``play_clock`` = text of k % 40
* ``week`` = day of month (the game's number inside its season);
  ``special_teams_play`` = k >= 90, ``penalty`` = 0,
  fourth-down converted / failed = down 4 with success 1 / 0
* kicker = ``K<user_id>`` normally, the backup ``B<user_id>`` on kicks with
  k >= 95 (so some team-games have two kickers and are dropped, F7)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["plays_from_events", "PLAYS_SQL"]


def plays_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    is_kick = et.isin("purchase", "error", "signup", "click")
    team = F.concat(F.lit("T"), F.col("user_id").cast("string"))
    backup = k >= 95
    kicker = F.when(is_kick, F.concat(F.when(backup, "B").otherwise("K"), F.col("user_id").cast("string")))
    kname = F.when(is_kick, F.concat(F.when(backup, "B.").otherwise("K."), F.col("user_id").cast("string")))
    home = ((F.dayofmonth("ts") + F.col("user_id")) % 2) == 0
    return events.select(
        F.col("event_id").alias("play_id"),
        F.to_date(F.date_trunc("week", "ts")).alias("season"),
        F.to_date("ts").cast("string").alias("game_id"),
        team.alias("posteam"),
        F.when(home, team).otherwise(F.concat(F.lit("O"), F.col("user_id").cast("string"))).alias("home_team"),
        F.when(et == "purchase", "made").when(et == "error", F.when(k >= 90, "blocked").otherwise("missed"))
         .alias("field_goal_result"),
        F.when(et == "signup", "good").when(et == "click", F.when(k >= 90, "blocked").otherwise("failed"))
         .alias("extra_point_result"),
        F.when(is_kick, (k + 17).cast("double")).alias("kick_distance"),
        kicker.alias("kicker_player_id"),
        kname.alias("kicker_player_name"),
        k.alias("yardline_100"),
        F.col("value").alias("epa"),
        F.concat(F.lit("T"), F.col("user_id").bitwiseXOR(F.lit(1)).cast("string")).alias("defteam"),
        et.isin("view", "click").cast("int").alias("rush"),
        et.isin("purchase", "signup").cast("int").alias("pass"),
        (F.col("value") - 35).alias("yards_gained"),
        (F.col("value") >= 40).cast("int").alias("success"),
        (F.floor("value") % 4 + 1).cast("int").alias("down"),
        (k % 40).cast("string").alias("play_clock"),
        F.dayofmonth("ts").alias("week"),
        (k >= 90).cast("int").alias("special_teams_play"),
        F.lit(0).alias("penalty"),
        ((F.floor("value") % 4 + 1 == 4) & (F.col("value") >= 40)).cast("int").alias("fourth_down_converted"),
        ((F.floor("value") % 4 + 1 == 4) & (F.col("value") < 40)).cast("int").alias("fourth_down_failed"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("ts"),
    )


# The same mapping in DuckDB SQL, used as a CTE by the oracles.
PLAYS_SQL = """
plays AS (
  SELECT event_id AS play_id,
         CAST(date_trunc('week', ts) AS DATE) AS season,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS game_id,
         'T' || CAST(user_id AS VARCHAR) AS posteam,
         CASE WHEN (dayofmonth(ts) + user_id) % 2 = 0 THEN 'T' || CAST(user_id AS VARCHAR)
              ELSE 'O' || CAST(user_id AS VARCHAR) END AS home_team,
         CASE WHEN event_type = 'purchase' THEN 'made'
              WHEN event_type = 'error' THEN CASE WHEN k >= 90 THEN 'blocked' ELSE 'missed' END END
           AS field_goal_result,
         CASE WHEN event_type = 'signup' THEN 'good'
              WHEN event_type = 'click' THEN CASE WHEN k >= 90 THEN 'blocked' ELSE 'failed' END END
           AS extra_point_result,
         CASE WHEN is_kick THEN CAST(k + 17 AS DOUBLE) END AS kick_distance,
         CASE WHEN is_kick THEN (CASE WHEN k >= 95 THEN 'B' ELSE 'K' END) || CAST(user_id AS VARCHAR) END
           AS kicker_player_id,
         CASE WHEN is_kick THEN (CASE WHEN k >= 95 THEN 'B.' ELSE 'K.' END) || CAST(user_id AS VARCHAR) END
           AS kicker_player_name,
         k AS yardline_100, value AS epa,
         'T' || CAST(xor(user_id, 1) AS VARCHAR) AS defteam,
         CAST(event_type IN ('view', 'click') AS INTEGER) AS rush,
         CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS pass,
         value - 35 AS yards_gained,
         CAST(value >= 40 AS INTEGER) AS success,
         CAST(CAST(floor(value) AS BIGINT) % 4 + 1 AS INTEGER) AS down,
         CAST(k % 40 AS VARCHAR) AS play_clock,
         dayofmonth(ts) AS week,
         CAST(k >= 90 AS INTEGER) AS special_teams_play,
         0 AS penalty,
         CAST(CAST(floor(value) AS BIGINT) % 4 + 1 = 4 AND value >= 40 AS INTEGER) AS fourth_down_converted,
         CAST(CAST(floor(value) AS BIGINT) % 4 + 1 = 4 AND value < 40 AS INTEGER) AS fourth_down_failed,
         user_id, event_type, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               event_type IN ('purchase', 'error', 'signup', 'click') AS is_kick
        FROM events) e
)"""
