"""Play-level queries over ``events`` (through the play adapter)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidelines.functions.domain import kick_points, made_distance, play_bucket, zone_masks
from sidelines.functions.nulls import first_by, n_distinct_na, rate
from sidelines.operators.aggregates import distinct_keys, frequency, null_profile, scalar
from sidelines.operators.joins import densify
from sidelines.operators.scan import Scan, scan_lagged, segmented_scan
from sidelines.operators.windows import (fill, global_row_number, group_id, lagged_cum,
                                         last_per_group, season_to_date_ratio)
from sidelines.plans.adapter import PLAYS_SQL, plays_from_events
from sidelines.plans.catalog import finish, register
from sidelines.plans.kicker import GAME_KEYS, kicker_features, kicker_games
from sidelines.sources.io import table

MIN_GAMES, MIN_ATTEMPTS = 3, 5  # a "season" of the adapter is one week of events


def plays(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return plays_from_events(table(spark, sf, "events"))


KICK = """
kick AS (
  SELECT *,
    CASE WHEN field_goal_result = 'made' AND kick_distance < 40 THEN 3
         WHEN field_goal_result = 'made' AND kick_distance < 50 THEN 4
         WHEN field_goal_result = 'made' THEN 5
         WHEN coalesce(field_goal_result IN ('missed', 'blocked'), false) THEN -1
         WHEN extra_point_result = 'good' THEN 1
         WHEN coalesce(extra_point_result IN ('failed', 'blocked'), false) THEN -1
         ELSE 999 END AS kick_fp,
    CASE WHEN field_goal_result = 'made' OR extra_point_result = 'good' THEN kick_distance END
      AS kick_made_distance
  FROM plays WHERE field_goal_result IS NOT NULL OR extra_point_result IS NOT NULL)"""

FACTS = """
facts AS (
  SELECT season, game_id, posteam, home_team,
    CAST(sum(kick_fp) AS BIGINT) AS total_points,
    count(*) FILTER (WHERE field_goal_result = 'made') AS n_fg,
    count(field_goal_result) AS n_fg_att,
    count(*) FILTER (WHERE extra_point_result = 'good') AS n_xp,
    count(extra_point_result) AS n_xp_att,
    max(kick_distance) AS max_dist,
    CASE WHEN NOT (count(*) FILTER (WHERE field_goal_result = 'made') = 0
                   AND count(*) FILTER (WHERE extra_point_result = 'good') = 0)
         THEN max(kick_made_distance) END AS max_made_dist,
    count(DISTINCT kicker_player_id) + max(CASE WHEN kicker_player_id IS NULL THEN 1 ELSE 0 END)
      AS kickers_per_team,
    arg_min(kicker_player_id, play_id) AS kicker_id,
    arg_min(kicker_player_name, play_id) AS kicker_name
  FROM kick GROUP BY season, game_id, posteam, home_team)"""

GAMES = """
spine AS (SELECT DISTINCT season, game_id, posteam, home_team FROM plays WHERE posteam IS NOT NULL),
games0 AS (
  SELECT s.season, s.game_id, s.posteam, s.home_team,
    coalesce(f.total_points, 0) AS total_points, coalesce(f.n_fg, 0) AS n_fg,
    coalesce(f.n_fg_att, 0) AS n_fg_att, coalesce(f.n_xp, 0) AS n_xp, coalesce(f.n_xp_att, 0) AS n_xp_att,
    f.max_dist, f.max_made_dist, f.kickers_per_team, f.kicker_id, f.kicker_name,
    CASE WHEN s.posteam = s.home_team THEN 1 ELSE 0 END AS kicker_home
  FROM spine s LEFT JOIN facts f
    ON s.season = f.season AND s.game_id = f.game_id AND s.posteam = f.posteam AND s.home_team = f.home_team
  WHERE f.kickers_per_team = 1 OR f.kickers_per_team IS NULL),
games AS (
  SELECT * REPLACE (
    coalesce(last_value(kicker_id IGNORE NULLS) OVER (PARTITION BY posteam, season ORDER BY game_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(kicker_id IGNORE NULLS) OVER (PARTITION BY posteam, season ORDER BY game_id
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kicker_id,
    coalesce(last_value(kicker_name IGNORE NULLS) OVER (PARTITION BY posteam, season ORDER BY game_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(kicker_name IGNORE NULLS) OVER (PARTITION BY posteam, season ORDER BY game_id
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kicker_name)
  FROM games0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


BASE = (PLAYS_SQL, KICK, FACTS)

# ---------------------------------------------------------------- flagship

KICKER_CTES = [*BASE, GAMES, f"""
tot AS (
  SELECT season, kicker_name, kicker_id, sum(n_fg) AS kfm, sum(n_fg_att) AS kfa, sum(n_xp) AS kxm,
         sum(n_xp_att) AS kxa, max(max_dist) AS kmd, max(max_made_dist) AS kmmd
  FROM games GROUP BY season, kicker_name, kicker_id)""", f"""
kicks AS (
  SELECT g.*, t.kfm AS kicker_szn_fg_made, t.kfa AS kicker_szn_fg_att, t.kxm AS kicker_szn_xp_made,
         t.kxa AS kicker_szn_xp_att, t.kmd AS kicker_szn_max_dist,
         CASE WHEN NOT (t.kfm = 0 AND t.kxm = 0) THEN t.kmmd END AS kicker_szn_max_made_dist,
         t.kfm / nullif(t.kfa, 0) AS kicker_szn_fg_pct, t.kxm / nullif(t.kxa, 0) AS kicker_szn_xp_pct,
         (t.kfa >= {MIN_ATTEMPTS} AND t.kxa >= {MIN_ATTEMPTS}) AS enough_kicks
  FROM games g LEFT JOIN tot t ON g.season = t.season
    AND g.kicker_name IS NOT DISTINCT FROM t.kicker_name AND g.kicker_id IS NOT DISTINCT FROM t.kicker_id)""", """
q AS (
  SELECT season, kicker_name, kicker_id, avg(kicker_szn_max_dist) AS d, avg(kicker_szn_max_made_dist) AS md
  FROM kicks WHERE enough_kicks GROUP BY season, kicker_name, kicker_id)""", """
meds AS (SELECT season, quantile_cont(d, 0.5) AS max_dist_to_impute,
                quantile_cont(md, 0.5) AS max_made_dist_to_impute FROM q GROUP BY season)""", """
grp AS (SELECT season, sum(kicker_szn_fg_made) / nullif(sum(kicker_szn_fg_att), 0) AS group_szn_fg_pct,
               sum(kicker_szn_xp_made) / nullif(sum(kicker_szn_xp_att), 0) AS group_szn_xp_pct
        FROM kicks GROUP BY season)""", """
imputed AS (
  SELECT k.* REPLACE (
    CASE WHEN enough_kicks THEN kicker_szn_fg_pct WHEN NOT enough_kicks THEN group_szn_fg_pct END AS kicker_szn_fg_pct,
    CASE WHEN enough_kicks THEN kicker_szn_xp_pct WHEN NOT enough_kicks THEN group_szn_xp_pct END AS kicker_szn_xp_pct,
    CASE WHEN enough_kicks THEN kicker_szn_max_dist WHEN NOT enough_kicks THEN max_dist_to_impute END
      AS kicker_szn_max_dist,
    CASE WHEN enough_kicks THEN kicker_szn_max_made_dist WHEN NOT enough_kicks THEN max_made_dist_to_impute END
      AS kicker_szn_max_made_dist)
  FROM kicks k LEFT JOIN meds m ON k.season = m.season LEFT JOIN grp g ON k.season = g.season)""", """
ks AS (
  SELECT kicker_name, kicker_id, season, avg(kicker_szn_fg_pct) AS fg, avg(kicker_szn_xp_pct) AS xp,
         max(kicker_szn_max_dist) AS md, max(kicker_szn_max_made_dist) AS mmd, count(*) AS games
  FROM imputed GROUP BY kicker_name, kicker_id, season)""", f"""
kl AS (
  SELECT kicker_name, kicker_id, season,
    lag(CASE WHEN games >= {MIN_GAMES} THEN fg END) OVER w AS sznlag_kicker_szn_fg_pct,
    lag(CASE WHEN games >= {MIN_GAMES} THEN xp END) OVER w AS sznlag_kicker_szn_xp_pct,
    lag(CASE WHEN games >= {MIN_GAMES} THEN md END) OVER w AS sznlag_kicker_szn_max_dist,
    lag(CASE WHEN games >= {MIN_GAMES} THEN mmd END) OVER w AS sznlag_kicker_szn_max_made_dist
  FROM ks WINDOW w AS (PARTITION BY kicker_name, kicker_id ORDER BY season))""", """
per AS (
  SELECT *, max(kicker_szn_max_dist) OVER (PARTITION BY kicker_name, kicker_id, season) AS kmd2,
            max(kicker_szn_max_made_dist) OVER (PARTITION BY kicker_name, kicker_id, season) AS kmmd2
  FROM imputed)""", """
sz AS (
  SELECT season, sum(n_fg) / nullif(sum(n_fg_att), 0) AS szn_fg_pct,
         sum(n_xp) / nullif(sum(n_xp_att), 0) AS szn_xp_pct,
         quantile_cont(kmd2, 0.5) AS szn_max_dist, quantile_cont(kmmd2, 0.5) AS szn_max_made_dist
  FROM per GROUP BY season)""", """
ll AS (
  SELECT season, lag(szn_fg_pct) OVER w AS lag_szn_fg_pct, lag(szn_xp_pct) OVER w AS lag_szn_xp_pct,
         lag(szn_max_dist) OVER w AS lag_szn_max_dist, lag(szn_max_made_dist) OVER w AS lag_szn_max_made_dist
  FROM sz WINDOW w AS (ORDER BY season))""", """
g2 AS (
  SELECT kicker_name, kicker_id, season, game_id, posteam, n_fg, n_fg_att, n_xp, n_xp_att,
    CASE WHEN max_dist IS NULL AND n_fg_att = 0 AND n_xp_att = 0 THEN 0.0 ELSE max_dist END AS max_dist,
    CASE WHEN max_made_dist IS NULL AND n_fg = 0 AND n_xp = 0 THEN 0.0 ELSE max_made_dist END AS max_made_dist
  FROM games)""", """
mv AS (
  SELECT *,
    sum(n_fg) OVER w / nullif(sum(n_fg_att) OVER w, 0) AS fg_pct_mv,
    sum(n_xp) OVER w / nullif(sum(n_xp_att) OVER w, 0) AS xp_pct_mv,
    CASE WHEN count(*) FILTER (WHERE max_dist IS NULL) OVER w = 0 THEN max(max_dist) OVER w END AS max_dist_mv,
    CASE WHEN count(*) FILTER (WHERE max_made_dist IS NULL) OVER w = 0 THEN max(max_made_dist) OVER w END
      AS max_made_dist_mv,
    CASE WHEN count(*) OVER w > 0 THEN count(kicker_name) OVER w END AS n_kkrszn_mv
  FROM g2 WINDOW w AS (PARTITION BY kicker_name, kicker_id, season ORDER BY game_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""]

KICKER_SELECT = f"""
SELECT mv.kicker_name, mv.kicker_id, mv.season, mv.game_id, mv.n_kkrszn_mv,
  round(CASE WHEN n_kkrszn_mv < {MIN_GAMES} OR n_kkrszn_mv IS NULL
       THEN coalesce(kl.sznlag_kicker_szn_fg_pct, ll.lag_szn_fg_pct) ELSE fg_pct_mv END, 6) AS fg_pct_mv,
  round(CASE WHEN n_kkrszn_mv < {MIN_GAMES} OR n_kkrszn_mv IS NULL
       THEN coalesce(kl.sznlag_kicker_szn_xp_pct, ll.lag_szn_xp_pct) ELSE xp_pct_mv END, 6) AS xp_pct_mv,
  round(CASE WHEN n_kkrszn_mv < {MIN_GAMES} OR n_kkrszn_mv IS NULL
       THEN coalesce(kl.sznlag_kicker_szn_max_dist, ll.lag_szn_max_dist) ELSE max_dist_mv END, 6) AS max_dist_mv,
  round(CASE WHEN n_kkrszn_mv < {MIN_GAMES} OR n_kkrszn_mv IS NULL
       THEN coalesce(kl.sznlag_kicker_szn_max_made_dist, ll.lag_szn_max_made_dist) ELSE max_made_dist_mv END, 6)
    AS max_made_dist_mv
FROM mv
LEFT JOIN kl ON mv.kicker_name IS NOT DISTINCT FROM kl.kicker_name
  AND mv.kicker_id IS NOT DISTINCT FROM kl.kicker_id AND mv.season = kl.season
LEFT JOIN ll ON mv.season = ll.season
"""

KICKER_FEATURES_SQL = with_(*KICKER_CTES) + KICKER_SELECT


@register("kicker_features", KICKER_FEATURES_SQL, headline=True)
def q_kicker_features(spark, sf):
    """W14-W16 (+W3-W5, W8, A11, W15, J3, F7, W10): the full season-to-date
    kicker feature job with the minimum-sample fallback chain."""
    return finish(kicker_features(plays(spark, sf), MIN_GAMES, MIN_ATTEMPTS))


# ---------------------------------------------------------------- facts

@register("points_rubric", with_(*BASE) + """
SELECT play_id, field_goal_result, extra_point_result, round(kick_distance, 6) AS kick_distance,
       CAST(kick_fp AS BIGINT) AS kick_fp FROM kick""")
def q_points_rubric(spark, sf):
    """Kick points rubric, NULLs falling through the branches."""
    p = plays(spark, sf)
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    return finish(p.where(fg.isNotNull() | xp.isNotNull()).select(
        "play_id", fg, xp, "kick_distance", kick_points(fg, "kick_distance", xp).alias("kick_fp")))


@register("actor_day_facts", with_(*BASE) + """
SELECT season, game_id, posteam, home_team, total_points, n_fg, n_fg_att, n_xp, n_xp_att,
       round(max_dist, 6) AS max_dist, round(max_made_dist, 6) AS max_made_dist FROM facts""", headline=True)
def q_actor_day_facts(spark, sf):
    """A3/A4/A5: kicker-game facts (sums, conditional counts, NA-aware max)."""
    g = kicker_games_facts(plays(spark, sf))
    return finish(g.select(*GAME_KEYS, "total_points", "n_fg", "n_fg_att", "n_xp", "n_xp_att",
                           "max_dist", "max_made_dist"))


def kicker_games_facts(p):
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    k = (p.where(fg.isNotNull() | xp.isNotNull())
         .withColumn("kick_fp", kick_points(fg, "kick_distance", xp))
         .withColumn("kick_made_distance", made_distance(fg, xp, "kick_distance")))
    return k.groupBy(*GAME_KEYS).agg(
        F.sum("kick_fp").alias("total_points"), F.count_if(fg == "made").alias("n_fg"),
        F.count(fg).alias("n_fg_att"), F.count_if(xp == "good").alias("n_xp"), F.count(xp).alias("n_xp_att"),
        F.max("kick_distance").alias("max_dist"), F.max("kick_made_distance").alias("max_made_dist"),
        n_distinct_na("kicker_player_id").alias("kickers_per_team"),
        first_by("kicker_player_id", "play_id").alias("kicker_id"),
        first_by("kicker_player_name", "play_id").alias("kicker_name"),
    ).withColumn("max_made_dist", F.when(~((F.col("n_fg") == 0) & (F.col("n_xp") == 0)), F.col("max_made_dist")))


@register("distinct_with_null", with_(PLAYS_SQL) + """
SELECT season, posteam,
       count(DISTINCT kicker_player_id) + max(CASE WHEN kicker_player_id IS NULL THEN 1 ELSE 0 END) AS kickers_na,
       count(DISTINCT kicker_player_id) AS kickers
FROM plays GROUP BY season, posteam""")
def q_distinct_with_null(spark, sf):
    """Distinct count that counts NULL as a value (next to the plain one)."""
    p = plays(spark, sf)
    return finish(p.groupBy("season", "posteam").agg(
        n_distinct_na("kicker_player_id").alias("kickers_na"),
        F.count_distinct("kicker_player_id").alias("kickers")))


@register("first_by_order", with_(*BASE) + """
SELECT season, game_id, posteam, arg_min(kicker_player_id, play_id) AS first_kicker,
       round(arg_min(kick_distance, play_id), 6) AS first_distance,
       round(arg_max(kick_distance, play_id), 6) AS last_distance
FROM kick GROUP BY season, game_id, posteam""")
def q_first_by_order(spark, sf):
    """First / last value in a defined row order (min_by / max_by)."""
    p = plays(spark, sf)
    k = p.where(F.col("field_goal_result").isNotNull() | F.col("extra_point_result").isNotNull())
    return finish(k.groupBy("season", "game_id", "posteam").agg(
        first_by("kicker_player_id", "play_id").alias("first_kicker"),
        first_by("kick_distance", "play_id").alias("first_distance"),
        F.max_by("kick_distance", "play_id").alias("last_distance")))


@register("spine_densify", with_(*BASE) + """
SELECT s.season, s.game_id, s.posteam, s.home_team,
       coalesce(f.n_fg, 0) AS n_fg, coalesce(f.n_fg_att, 0) AS n_fg_att,
       coalesce(f.total_points, 0) AS total_points, f.kickers_per_team
FROM (SELECT DISTINCT season, game_id, posteam, home_team FROM plays WHERE posteam IS NOT NULL) s
LEFT JOIN facts f ON s.season = f.season AND s.game_id = f.game_id AND s.posteam = f.posteam
  AND s.home_team = f.home_team""")
def q_spine_densify(spark, sf):
    """A1 + J3 + X8: every team-game of the spine survives, zero-filled."""
    p = plays(spark, sf)
    facts = kicker_games_facts(p)
    spine = distinct_keys(p.where(F.col("posteam").isNotNull()), GAME_KEYS)
    out = densify(facts, spine, GAME_KEYS, ["n_fg", "n_fg_att", "total_points"])
    return finish(out.select(*GAME_KEYS, "n_fg", "n_fg_att", "total_points", "kickers_per_team"))


@register("kicker_games", with_(*BASE, GAMES) + """
SELECT season, game_id, posteam, home_team, total_points, n_fg, n_fg_att, n_xp, n_xp_att,
       round(max_dist, 6) AS max_dist, round(max_made_dist, 6) AS max_made_dist, kickers_per_team,
       kicker_id, kicker_name, CAST(kicker_home AS BIGINT) AS kicker_home FROM games""")
def q_kicker_games(spark, sf):
    """F7 + J3 + W10: kicker-game rows on the spine, multi-kicker games dropped,
    kicker filled down then up within the team-season."""
    return finish(kicker_games(plays(spark, sf)))


# ---------------------------------------------------------------- windows

@register("season_to_date_ratio", with_(*BASE) + """
SELECT season, posteam, game_id,
  round(sum(n_fg) OVER w / nullif(sum(n_fg_att) OVER w, 0), 6) AS fg_pct_std,
  round(sum(n_xp) OVER w / nullif(sum(n_xp_att) OVER w, 0), 6) AS xp_pct_std,
  CAST(sum(total_points) OVER w AS BIGINT) AS points_std
FROM facts WINDOW w AS (PARTITION BY posteam, season ORDER BY game_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_season_to_date_ratio(spark, sf):
    """Lagged cumulative sums and their ratio (no leakage)."""
    f = kicker_games_facts(plays(spark, sf))
    K, O = ["posteam", "season"], ["game_id"]
    return finish(f.select("season", "posteam", "game_id",
                           season_to_date_ratio("n_fg", "n_fg_att", K, O).alias("fg_pct_std"),
                           season_to_date_ratio("n_xp", "n_xp_att", K, O).alias("xp_pct_std"),
                           lagged_cum("total_points", "sum", K, O).alias("points_std")))


@register("lagged_cummax", with_(*BASE) + """
SELECT season, posteam, game_id,
  round(CASE WHEN count(*) FILTER (WHERE max_made_dist IS NULL) OVER w = 0 THEN max(max_made_dist) OVER w END, 6)
    AS made_dist_cummax_poison,
  round(max(max_made_dist) OVER w, 6) AS made_dist_cummax
FROM facts WINDOW w AS (PARTITION BY posteam, season ORDER BY game_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_lagged_cummax(spark, sf):
    """W5 + N7: lagged cumulative max, NULL-skipping and NULL-poisoning."""
    f = kicker_games_facts(plays(spark, sf))
    K, O = ["posteam", "season"], ["game_id"]
    return finish(f.select("season", "posteam", "game_id",
                           lagged_cum("max_made_dist", "max", K, O, na="poison").alias("made_dist_cummax_poison"),
                           lagged_cum("max_made_dist", "max", K, O).alias("made_dist_cummax")))


@register("lagged_cummean", with_(*BASE) + """
SELECT season, posteam, game_id,
  round(avg(total_points) OVER w, 6) AS points_cummean,
  round(sum(n_fg) OVER w / nullif(avg(n_fg_att) OVER w, 0), 6) AS q3_ratio
FROM facts WINDOW w AS (PARTITION BY posteam, season ORDER BY game_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_lagged_cummean(spark, sf):
    """W6 + W7: lagged cumulative mean, and a cumulative mean used as a
    denominator (quirk Q3 reproduced)."""
    f = kicker_games_facts(plays(spark, sf))
    K, O = ["posteam", "season"], ["game_id"]
    return finish(f.select("season", "posteam", "game_id",
                           lagged_cum("total_points", "mean", K, O).alias("points_cummean"),
                           F.try_divide(lagged_cum("n_fg", "sum", K, O),
                                        lagged_cum("n_fg_att", "mean", K, O)).alias("q3_ratio")))


@register("lagged_count", with_(*BASE, GAMES) + """
SELECT season, posteam, game_id,
  CASE WHEN count(*) OVER w > 0 THEN count(kicker_name) OVER w END AS n_prior_games
FROM games0 WINDOW w AS (PARTITION BY posteam, season ORDER BY game_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_lagged_count(spark, sf):
    """W8 + N9: lagged running count of non-NULL values, NULL on the first row."""
    g = kicker_games_unfilled(plays(spark, sf))
    return finish(g.select("season", "posteam", "game_id",
                           lagged_cum("kicker_name", "count", ["posteam", "season"], ["game_id"])
                           .alias("n_prior_games")))


def kicker_games_unfilled(p):
    facts = kicker_games_facts(p)
    spine = distinct_keys(p.where(F.col("posteam").isNotNull()), GAME_KEYS)
    g = densify(facts, spine, GAME_KEYS, ["n_fg", "n_fg_att", "n_xp", "n_xp_att", "total_points"])
    return g.where((F.col("kickers_per_team") == 1) | F.col("kickers_per_team").isNull())


@register("fill_down", with_(*BASE, GAMES) + """
SELECT season, posteam, game_id,
  last_value(kicker_id IGNORE NULLS) OVER (PARTITION BY posteam, season ORDER BY game_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kicker_id
FROM games0""")
def q_fill_down(spark, sf):
    """Fill down within the team-season."""
    g = kicker_games_unfilled(plays(spark, sf)).select("season", "posteam", "game_id", "kicker_id")
    return finish(fill(g, ["posteam", "season"], ["game_id"], ["kicker_id"], "down"))


@register("fill_downup", with_(*BASE, GAMES) + """
SELECT season, posteam, game_id, kicker_id, kicker_name FROM games""")
def q_fill_downup(spark, sf):
    """Fill down, then up."""
    g = kicker_games_unfilled(plays(spark, sf)).select("season", "posteam", "game_id", "kicker_id", "kicker_name")
    return finish(fill(g, ["posteam", "season"], ["game_id"], ["kicker_id", "kicker_name"], "downup"))


@register("row_index", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events""")
def q_row_index(spark, sf):
    """Row number per user by time, range-partitioned (a user holding a
    large share of all events is split over many tasks)."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return finish(global_row_number(e, ["ts", "event_id"], "idx", keys=["user_id"]).drop("ts"))


@register("running_raw", """
SELECT event_id, event_type, CAST(sum(cents) OVER w AS BIGINT) AS cents_sum, max(cents) OVER w AS cents_max, min(cents) OVER w AS cents_min,
  round(avg(cents) OVER w, 6) AS cents_mean, CASE WHEN count(*) OVER w > 0 THEN count(big) OVER w END AS n_big,
  CAST(CASE WHEN count(*) OVER w > 0 AND count(*) FILTER (WHERE small IS NULL) OVER w = 0 THEN sum(small) OVER w END AS BIGINT) AS small_poison,
  round(sum(cents) OVER w / nullif(sum(big) OVER w, 0), 6) AS ratio
FROM (SELECT *, CASE WHEN cents >= 6000 THEN cents END AS big, CASE WHEN event_id % 997 <> 500 THEN cents END AS small
      FROM (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events))
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_running_raw(spark, sf):
    """W3-W8 on raw rows: five groups hold all events, so each is scanned in
    pieces by many tasks and the pieces' sums are carried on."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    e = table(spark, sf, "events").select(
        "event_id", "event_type", "ts", cents.alias("cents"), F.when(cents >= 6000, cents).alias("big"),
        F.when(F.col("event_id") % 997 != 500, cents).alias("small"))
    out = scan_lagged(e, ["event_type"], ["ts", "event_id"], cents_sum=("cents", "sum"), cents_max=("cents", "max"), cents_min=("cents", "min"),
                      cents_mean=("cents", "mean"), n_big=("big", "count"), small_poison=("small", "sum", "poison"), big_sum=("big", "sum"))
    return finish(out.withColumn("ratio", F.try_divide("cents_sum", "big_sum")).drop("ts", "cents", "big", "small", "big_sum"))


@register("fill_raw", """
SELECT event_id, event_type,
  last_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down,
  coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS downup
FROM (SELECT *, CASE WHEN event_id % 11 = 3 THEN user_id END AS k FROM events)""")
def q_fill_raw(spark, sf):
    """W9 + W10 on raw rows of five large groups."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 11 == 3, F.col("user_id")).alias("k"))
    out = segmented_scan(e, ["event_type"], ["ts", "event_id"], {"down": Scan("last", "k"), "up": Scan("last", "k", reverse=True)})
    return finish(out.select("event_id", "event_type", "down", F.coalesce("down", "up").alias("downup")))


@register("last_per_group", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
       round(arg_max(value, (ts, event_id)), 6) AS value, count(*) AS n
FROM events GROUP BY user_id""")
def q_last_per_group(spark, sf):
    """Last row per group plus the group size (algebraic max_by)."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    out = last_per_group(e, ["user_id"], ["ts", "event_id"], "n")
    return finish(out.select("user_id", "event_id", "event_type", "value", "n"))


@register("group_id", with_(PLAYS_SQL) + """
SELECT DISTINCT season, posteam, dense_rank() OVER (ORDER BY season, posteam) AS group_id
FROM plays WHERE posteam IS NOT NULL""")
def q_group_id(spark, sf):
    """Dense group id in key order, computed distributedly."""
    p = plays(spark, sf).where(F.col("posteam").isNotNull()).select("season", "posteam")
    return finish(group_id(p, ["season", "posteam"]).distinct())


# ---------------------------------------------------------------- misc aggregates

@register("frequency", with_(PLAYS_SQL) + """
SELECT event_type, season, count(*) AS n FROM plays GROUP BY event_type, season""")
def q_frequency(spark, sf):
    """A2: frequency count by keys."""
    return finish(frequency(plays(spark, sf), ["event_type", "season"]))


@register("distinct_probe", with_(PLAYS_SQL) + """
SELECT DISTINCT field_goal_result, extra_point_result, CAST(down AS BIGINT) AS down FROM plays""")
def q_distinct_probe(spark, sf):
    """Distinct values probe."""
    return finish(distinct_keys(plays(spark, sf), ["field_goal_result", "extra_point_result", "down"]))


NULL_COLS = ["field_goal_result", "extra_point_result", "kick_distance", "kicker_player_id", "yardline_100",
             "epa", "defteam"]


@register("null_profile", with_(PLAYS_SQL) + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in NULL_COLS) + " FROM plays")
def q_null_profile(spark, sf):
    """NULL count for every column in one pass."""
    return finish(null_profile(plays(spark, sf), NULL_COLS))


@register("global_mean_fallback", with_(*BASE, GAMES) + """
SELECT season, posteam, game_id, total_points,
  round(coalesce(avg(total_points) OVER (PARTITION BY season, posteam, kicker_id, kicker_name ORDER BY game_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 (SELECT avg(total_points) FROM games)), 6) AS szn_kkr_mean_pts
FROM games""")
def q_global_mean_fallback(spark, sf):
    """A13 + W17: season-to-date mean with the overall mean (a scalar
    subquery, computed once) for the first game."""
    g = kicker_games(plays(spark, sf))
    overall = scalar(g.agg(F.avg("total_points")))
    K = ["season", "posteam", "kicker_id", "kicker_name"]
    return finish(g.select("season", "posteam", "game_id", "total_points",
                           F.coalesce(lagged_cum("total_points", "mean", K, ["game_id"]), overall)
                           .alias("szn_kkr_mean_pts")))


@register("zone_rates", with_(PLAYS_SQL) + """
SELECT posteam, season,
  round(avg(CASE WHEN yardline_100 < 20 THEN epa END), 6) AS off_rz_epa,
  round(avg(CASE WHEN yardline_100 < 40 AND yardline_100 >= 20 THEN epa END), 6) AS off_pz_epa,
  round(avg(CASE WHEN rush = 1 THEN epa END), 6) AS off_rush_epa,
  round(avg(CASE WHEN rush = 1 THEN NULL WHEN pass = 1 THEN epa END), 6) AS off_pass_epa,
  round(sum(CASE WHEN yards_gained >= 20 THEN 1 ELSE 0 END) / count(*), 6) AS big_play_20_rate,
  round(sum(CASE WHEN yards_gained <= -5 THEN 1 ELSE 0 END) / count(*), 6) AS neg_play_5_rate,
  round(sum(success) / count(*), 6) AS off_success_rate,
  count(*) FILTER (WHERE CASE WHEN rush = 1 THEN 'rush' WHEN pass = 1 THEN 'pass' ELSE 'other' END = 'other')
    AS n_other
FROM plays WHERE posteam IS NOT NULL GROUP BY posteam, season""")
def q_zone_rates(spark, sf):
    """X16 + X17 + A12: zone masks, play buckets and per-team rates."""
    p = plays(spark, sf).where(F.col("posteam").isNotNull())
    z = zone_masks("yardline_100", "epa", "yards_gained")
    p = p.withColumns({**z, "rushpass": play_bucket("rush", "pass")})
    return finish(p.groupBy("posteam", "season").agg(
        F.avg("redzone_epa").alias("off_rz_epa"), F.avg("pinkzone_epa").alias("off_pz_epa"),
        F.avg(F.when(F.col("rushpass") == "rush", F.col("epa"))).alias("off_rush_epa"),
        F.avg(F.when(F.col("rushpass") == "pass", F.col("epa"))).alias("off_pass_epa"),
        rate(F.sum("big_play_20"), F.count(F.lit(1))).alias("big_play_20_rate"),
        rate(F.sum("neg_play_5"), F.count(F.lit(1))).alias("neg_play_5_rate"),
        rate(F.sum("success"), F.count(F.lit(1))).alias("off_success_rate"),
        F.count_if(F.col("rushpass") == "other").alias("n_other")))
