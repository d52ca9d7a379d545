"""Team offence / defence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sidelines.plans.adapter import PLAYS_SQL
from sidelines.plans.catalog import finish, register
from sidelines.plans.context import CONTEXT_SQL
from sidelines.plans.final import OPPONENT_DEF, OPPONENT_OFF, ZONE_DEF, ZONE_OFF
from sidelines.plans.q_plays import plays
from sidelines.plans.team import (DEF_MA_COLS, OFF_MA_COLS, defense_mvavg, offense_mvavg, pos_def, season_level,
                                  zone_defense, zone_offense)

SL_CTES = """
sl0 AS (SELECT *, CASE WHEN down = 4 THEN 1 WHEN down <> 4 THEN 0 END AS fourth_down FROM plays),
fd AS (SELECT posteam, season, sum(fourth_down) AS fourth_down_n_season FROM sl0 GROUP BY 1, 2),
sl AS (
  SELECT s.*, fd.fourth_down_n_season,
    CASE WHEN yardline_100 < 20 THEN epa END AS redzone_epa,
    CASE WHEN yardline_100 < 40 AND yardline_100 >= 20 THEN epa END AS pinkzone_epa,
    CASE WHEN yards_gained >= 20 THEN 1 WHEN NOT (yards_gained >= 20) THEN 0 END AS big_play_20,
    CASE WHEN yards_gained <= -5 THEN 1 WHEN NOT (yards_gained <= -5) THEN 0 END AS neg_play_5,
    CASE WHEN rush = 1 THEN 'rush' WHEN pass = 1 THEN 'pass' ELSE 'other' END AS rushpass
  FROM sl0 s LEFT JOIN fd ON s.posteam = fd.posteam AND s.season = fd.season
  WHERE s.posteam IS NOT NULL AND (rush = 1 OR pass = 1 OR penalty = 1) AND special_teams_play = 0)"""
SL_SQL = PLAYS_SQL + "," + SL_CTES


def _r(num, den, w="w"):
    return f"sum({num}) OVER {w} / nullif(sum({den}) OVER {w}, 0)"


def _fill(cols, part):
    return ", ".join(f"round(last_value({c} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY season, week "
                     f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS {c}" for c in cols)


OFF_CTES = """
off_wk AS (
  SELECT season, posteam, week,
    coalesce(sum(redzone_epa), 0) AS off_rz_epa, coalesce(sum(pinkzone_epa), 0) AS off_pz_epa,
    count(redzone_epa) AS n_off_rz, count(pinkzone_epa) AS n_off_pz,
    coalesce(sum(redzone_epa), 0) AS off_rush_epa, coalesce(sum(pinkzone_epa), 0) AS off_pass_epa,
    coalesce(sum(epa), 0) AS off_epa, coalesce(sum(success), 0) AS success_plays, count(*) AS n_plays,
    count(*) FILTER (WHERE yardline_100 >= 20) AS n_plays_20, count(*) FILTER (WHERE yardline_100 <= 95) AS n_plays_5,
    count(*) FILTER (WHERE rushpass = 'rush') AS n_off_rush, count(*) FILTER (WHERE rushpass = 'pass') AS n_off_pass,
    coalesce(sum(big_play_20), 0) AS big_play_20_n, coalesce(sum(neg_play_5), 0) AS neg_play_5_n,
    coalesce(sum(TRY_CAST(play_clock AS DOUBLE)), 0) AS sum_play_clock, coalesce(sum(fourth_down), 0) AS fourth_down_n,
    coalesce(sum(fourth_down_converted + fourth_down_failed), 0) AS fourth_down_att
  FROM sl GROUP BY 1, 2, 3),
off_ma AS (
  SELECT posteam, season, week, """ + ", ".join([
    _r("off_rz_epa", "n_off_rz") + " AS off_rz_epa_ma", _r("off_pz_epa", "n_off_pz") + " AS off_pz_epa_ma",
    _r("off_epa", "n_plays") + " AS off_epa_ma", _r("off_rush_epa", "n_off_rush") + " AS off_rush_epa_ma",
    _r("off_pass_epa", "n_off_pass") + " AS off_pass_epa_ma", _r("big_play_20_n", "n_plays_20") + " AS big_play_20_rate_ma",
    _r("neg_play_5_n", "n_plays_5") + " AS neg_play_5_rate_ma", _r("sum_play_clock", "n_plays") + " AS mean_play_clock_ma",
    _r("fourth_down_att", "fourth_down_n") + " AS fourth_down_try_rate_ma",
    "sum(success_plays) OVER w / nullif(sum(n_plays) OVER w2, 0) AS off_success_rate_ma"]) + """
  FROM off_wk WINDOW w AS (PARTITION BY season, posteam ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 w2 AS (PARTITION BY season, posteam ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
off_mv AS (SELECT posteam, season, CAST(week AS BIGINT) AS week, """ + _fill(OFF_MA_COLS, "posteam") + " FROM off_ma)"
OFF_SQL = "WITH " + SL_SQL + "," + OFF_CTES + "\nSELECT * FROM off_mv"


@register("team_week_offense", OFF_SQL)
def q_team_week_offense(spark, sf):
    """W3/W4 + W9 + Q1/Q2/Q18/Q19: season-to-date team offence per week with
    the source's quirks reproduced (parity), filled down across seasons."""
    return finish(offense_mvavg(season_level(plays(spark, sf)), parity=True))


DEF_CTES = """
def_wk AS (
  SELECT season, defteam, week,
    coalesce(sum(redzone_epa), 0) AS def_rz_epa, coalesce(sum(pinkzone_epa), 0) AS def_pz_epa,
    coalesce(sum(epa), 0) AS def_epa, count(redzone_epa) AS n_def_rz, count(pinkzone_epa) AS n_def_pz,
    count(*) AS n_plays, coalesce(sum(CASE WHEN rushpass = 'rush' THEN epa END), 0) AS def_rush_epa,
    coalesce(sum(CASE WHEN rushpass = 'pass' THEN epa END), 0) AS def_pass_epa,
    count(*) FILTER (WHERE rushpass = 'rush') AS n_def_rush, count(*) FILTER (WHERE rushpass = 'pass') AS n_def_pass,
    coalesce(sum(success), 0) AS success_plays
  FROM sl GROUP BY 1, 2, 3),
def_ma AS (
  SELECT defteam, season, week, """ + ", ".join([
    _r("def_rz_epa", "n_def_rz") + " AS def_rz_epa_ma", _r("def_pz_epa", "n_def_pz") + " AS def_pz_epa_ma",
    _r("def_epa", "n_plays") + " AS def_epa_ma", _r("def_rush_epa", "n_def_rush") + " AS def_rush_epa_ma",
    _r("def_pass_epa", "n_def_pass") + " AS def_pass_epa_ma",
    "sum(success_plays) OVER w / nullif(avg(n_plays) OVER w, 0) AS def_success_rate_ma"]) + """
  FROM def_wk WINDOW w AS (PARTITION BY season, defteam ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
def_mv AS (SELECT defteam, season, CAST(week AS BIGINT) AS week, """ + _fill(DEF_MA_COLS, "defteam") + " FROM def_ma)"
DEF_SQL = "WITH " + SL_SQL + "," + DEF_CTES + "\nSELECT * FROM def_mv"


@register("team_week_defense", DEF_SQL)
def q_team_week_defense(spark, sf):
    """W3/W4/W7 + W9 + Q3: season-to-date team defence per week (parity:
    success rate over a cumulative mean)."""
    return finish(defense_mvavg(season_level(plays(spark, sf)), parity=True))


ZONE_CTES = """
zo AS (
  SELECT posteam, season, avg(redzone_epa) AS off_rz_epa, avg(pinkzone_epa) AS off_pz_epa, avg(epa) AS off_epa,
    avg(CASE WHEN rushpass = 'rush' THEN epa END) AS off_rush_epa, avg(CASE WHEN rushpass = 'pass' THEN epa END) AS off_pass_epa,
    coalesce(sum(success), 0) / count(*) AS off_success_rate, coalesce(sum(big_play_20), 0) / count(*) AS big_play_20_rate,
    coalesce(sum(neg_play_5), 0) / count(*) AS neg_play_5_rate, avg(TRY_CAST(play_clock AS DOUBLE)) AS mean_play_clock,
    first(fourth_down_n_season) AS fourth_down_n,
    coalesce(sum(fourth_down_converted + fourth_down_failed), 0) AS fourth_down_att
  FROM sl GROUP BY 1, 2),
zd AS (SELECT defteam, season, avg(epa) AS def_epa, coalesce(sum(success), 0) / count(*) AS def_success_rate,
              avg(redzone_epa) AS def_rz_epa, avg(pinkzone_epa) AS def_pz_epa, avg(CASE WHEN rushpass = 'rush' THEN epa END) AS def_rush_epa,
              avg(CASE WHEN rushpass = 'pass' THEN epa END) AS def_pass_epa
       FROM sl GROUP BY 1, 2)"""
ZONES_SQL = "WITH " + SL_SQL + "," + ZONE_CTES + """
SELECT zo.posteam, zo.season, round(off_rz_epa, 6) AS off_rz_epa, round(off_pz_epa, 6) AS off_pz_epa,
  round(off_epa, 6) AS off_epa, round(off_rush_epa, 6) AS off_rush_epa, round(off_pass_epa, 6) AS off_pass_epa,
  round(off_success_rate, 6) AS off_success_rate, round(big_play_20_rate, 6) AS big_play_20_rate,
  round(neg_play_5_rate, 6) AS neg_play_5_rate, round(mean_play_clock, 6) AS mean_play_clock,
  CAST(fourth_down_n AS BIGINT) AS fourth_down_n, CAST(fourth_down_att AS BIGINT) AS fourth_down_att,
  round(fourth_down_att / nullif(fourth_down_n, 0), 6) AS fourth_down_try_rate,
  round(zd.def_epa, 6) AS pos_def_epa, round(zd.def_success_rate, 6) AS pos_def_success_rate
FROM zo LEFT JOIN zd ON zo.posteam = zd.defteam AND zo.season = zd.season"""


@register("team_season_zones", ZONES_SQL)
def q_team_season_zones(spark, sf):
    """Full-season offence (Q19 fourth-down denominator, Q18 play clock) with
    the team's own defence joined back through a role swap (J9, P2)."""
    sl = season_level(plays(spark, sf))
    out = zone_offense(sl).join(pos_def(zone_defense(sl)), ["posteam", "season"], "left")
    return finish(out)



# ---------------------------------------------------------------- modelling table

FIRST_SEASON = "2024-01-01"
# (week, SQL condition, Spark condition built lazily: no Column before a session exists)
LAST_DAYS = [(28, "fd1.season > DATE '2024-01-15'", lambda: F.col("season") > F.lit("2024-01-15").cast("date")),
             (21, "fd1.season = DATE '2024-01-15'", lambda: F.col("season") == F.lit("2024-01-15").cast("date"))]


def _final_sql():
    from sidelines.plans.q_plays import KICKER_CTES, KICKER_SELECT, with_
    ctes = [*KICKER_CTES,
            "kmv AS (" + KICKER_SELECT.replace("SELECT mv.kicker_name, mv.kicker_id, mv.season, mv.game_id,",
                                               "SELECT mv.kicker_name, mv.kicker_id, mv.season, mv.game_id, mv.posteam,")
            + ")",
            SL_CTES.strip(), ZONE_CTES.strip(), OFF_CTES.strip(), DEF_CTES.strip(), CONTEXT_SQL.strip(), """
gl AS (SELECT season, game_id, posteam, defteam, count(*) AS playcount,
              count(*) FILTER (WHERE field_goal_result = 'made') AS fg_atts,
              count(*) FILTER (WHERE extra_point_result = 'good') AS xp_atts
       FROM plays WHERE posteam IS NOT NULL AND defteam IS NOT NULL GROUP BY 1, 2, 3, 4)""", f"""
fd0 AS (
  SELECT i.season, i.game_id, i.posteam, gl.defteam, gl.playcount, gl.fg_atts, gl.xp_atts, i.kicker_id, i.kicker_name,
         i.total_points, i.kicker_home, i.kicker_szn_max_dist, i.kicker_szn_fg_pct, i.kicker_szn_xp_pct, k.fg_pct_mv, k.xp_pct_mv, k.max_dist_mv, k.max_made_dist_mv
  FROM gl RIGHT JOIN imputed i ON gl.season = i.season AND gl.game_id = i.game_id AND gl.posteam = i.posteam
  LEFT JOIN kmv k ON i.season = k.season AND i.game_id = k.game_id AND i.posteam IS NOT DISTINCT FROM k.posteam
    AND i.kicker_id IS NOT DISTINCT FROM k.kicker_id AND i.kicker_name IS NOT DISTINCT FROM k.kicker_name)""", f"""
fd1 AS (
  SELECT *,
    coalesce(avg(total_points) OVER (PARTITION BY season, defteam ORDER BY game_id, posteam
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             (SELECT avg(total_points) FROM imputed WHERE season > DATE '{FIRST_SEASON}')) AS szn_def_kkr_mean_pts,
    coalesce(avg(total_points) OVER (PARTITION BY season, posteam, kicker_id, kicker_name ORDER BY game_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             (SELECT avg(total_points) FROM imputed WHERE season > DATE '{FIRST_SEASON}')) AS szn_kkr_mean_pts,
    TRY_CAST(substring(game_id, 9, 2) AS INTEGER) AS week
  FROM fd0)"""]
    excl = " AND ".join(f"NOT coalesce(fd1.week = {w} AND {c}, false)" for w, c, _ in LAST_DAYS)
    def fraction(table: str, c: str) -> str:
        """The season's fourth-down rate is a ratio of two of the table's columns."""
        return f"{table}.fourth_down_att / nullif({table}.fourth_down_n, 0)" if c == "fourth_down_try_rate" else f"{table}.{c}"

    team = [(t, c, c) for t, cols in (("zo", ZONE_OFF), ("zd", ZONE_DEF), ("om", OFF_MA_COLS), ("dm", DEF_MA_COLS)) for c in cols]
    team += [(t, f"{a}{ma}", f"{b}{ma}") for t, names, ma in (("zo2", OPPONENT_OFF, ""), ("zd2", OPPONENT_DEF, ""), ("om2", OPPONENT_OFF, "_ma"),
                                                              ("dm2", OPPONENT_DEF, "_ma")) for a, b in names.items()]
    team_columns = ", ".join(f"round({fraction(t, a)}, 6) AS {b}" for t, a, b in team)
    sel = f"""
SELECT fd1.season, fd1.game_id, fd1.posteam, fd1.defteam, CAST(fd1.week AS BIGINT) AS week, kicker_id, kicker_name,
  CAST(CASE WHEN fg_atts = 0 AND xp_atts = 0 THEN 0 ELSE total_points END AS BIGINT) AS total_points,
  playcount, fg_atts, xp_atts,
  round(fg_pct_mv, 6) AS fg_pct_mv, round(xp_pct_mv, 6) AS xp_pct_mv, round(max_dist_mv, 6) AS max_dist_mv,
  round(max_made_dist_mv, 6) AS max_made_dist_mv, round(szn_kkr_mean_pts, 6) AS szn_kkr_mean_pts,
  round(szn_def_kkr_mean_pts, 6) AS szn_def_kkr_mean_pts,
  CAST(kicker_home AS BIGINT) AS kicker_home, round(kicker_szn_max_dist, 6) AS kicker_szn_max_dist, round(kicker_szn_fg_pct, 6) AS kicker_szn_fg_pct,
  round(kicker_szn_xp_pct, 6) AS kicker_szn_xp_pct,
  {team_columns},
  round(pos_imptot, 6) AS pos_imptot, round(def_imptot, 6) AS def_imptot, round(pos_imptotdiff, 6) AS pos_imptotdiff, round(wind_weather, 6) AS wind_weather,
  roof, precipitation, CAST(roof = 'closed' AS BIGINT) AS roof_closed, CAST(roof = 'dome' AS BIGINT) AS roof_dome, CAST(roof = 'open' AS BIGINT) AS roof_open,
  CAST(precipitation = 'unknown' AS BIGINT) AS precipitation_unknown, CAST(precipitation = 'yes' AS BIGINT) AS precipitation_yes,
  CAST(pos_score AS BIGINT) AS pos_score, CAST(def_score AS BIGINT) AS def_score, round(fpts_site, 6) AS fpts_site,
  coalesce(fd1.posteam, 'NA') || '_' || CAST(fd1.season AS VARCHAR) AS posteam_seas
FROM fd1
LEFT JOIN zo ON fd1.season = zo.season AND fd1.posteam = zo.posteam
LEFT JOIN zd ON fd1.season = zd.season AND fd1.defteam = zd.defteam
LEFT JOIN off_mv om ON fd1.season = om.season AND fd1.posteam = om.posteam AND fd1.week = om.week
LEFT JOIN def_mv dm ON fd1.season = dm.season AND fd1.defteam = dm.defteam AND fd1.week = dm.week
LEFT JOIN zo zo2 ON fd1.season = zo2.season AND fd1.defteam = zo2.posteam
LEFT JOIN zd zd2 ON fd1.season = zd2.season AND fd1.posteam = zd2.defteam
LEFT JOIN off_mv om2 ON fd1.season = om2.season AND fd1.defteam = om2.posteam AND fd1.week = om2.week
LEFT JOIN def_mv dm2 ON fd1.season = dm2.season AND fd1.posteam = dm2.defteam AND fd1.week = dm2.week
LEFT JOIN ctx ON fd1.game_id = ctx.game_id AND fd1.posteam = ctx.posteam
WHERE fd1.season > DATE '{FIRST_SEASON}' AND {excl}"""
    return with_(*ctes) + sel


@register("final_data", _final_sql(), headline=True)
def q_final_data(spark, sf):
    """J4 + J2 + J8 + J9 + W17 + Q4 + Q7 + P9: kicker-game rows enriched by
    eight chained left joins (own and opponent roles, full-season and
    season-to-date), first season dropped after the lags, last-day exclusion."""
    from sidelines.plans.final import final_data
    from sidelines.plans.q_plays import MIN_ATTEMPTS, MIN_GAMES
    return finish(final_data(plays(spark, sf), MIN_GAMES, MIN_ATTEMPTS, first_season=FIRST_SEASON,
                             exclude_weeks=[(w, c()) for w, _, c in LAST_DAYS], parity=True))


@register("final_avg", _final_sql().replace("\nSELECT fd1.season, fd1.game_id,", "\n, fdx AS (SELECT fd1.season, fd1.game_id,", 1)
          .rstrip() + """),
lastrow AS (
  SELECT kicker_name, kicker_id, season, count(*) AS games_kicked,
         arg_max_null(fg_pct_mv, (season, posteam, week)) AS fg_pct_mv,
         arg_max_null(xp_pct_mv, (season, posteam, week)) AS xp_pct_mv
  FROM fdx GROUP BY kicker_name, kicker_id, season)
SELECT round(avg(fg_pct_mv), 5) AS fg_pct_mv_mean, round(stddev_samp(fg_pct_mv), 5) AS fg_pct_mv_sd,
       round(quantile_cont(xp_pct_mv, 0.5), 5) AS xp_pct_mv_median,
       round(quantile_cont(xp_pct_mv, 0.75) - quantile_cont(xp_pct_mv, 0.25), 5) AS xp_pct_mv_iqr,
       count(*) AS n_kicker_seasons
FROM lastrow WHERE games_kicked >= 3""")
def q_final_avg(spark, sf):
    """W12 + F5 + A8-A10 (+Q17 order): last row of each kicker-season in the
    modelling table (by season, team, week) and its game count; qualified
    kicker-seasons summarised by mean / sd of FG% and median / IQR of XP%."""
    from sidelines.operators.aggregates import iqr, median
    from sidelines.operators.windows import last_per_group
    from sidelines.plans.final import final_data
    from sidelines.plans.q_plays import MIN_ATTEMPTS, MIN_GAMES
    fd = final_data(plays(spark, sf), MIN_GAMES, MIN_ATTEMPTS, first_season=FIRST_SEASON,
                    exclude_weeks=[(w, c()) for w, _, c in LAST_DAYS], parity=True)
    last = last_per_group(fd.select("kicker_name", "kicker_id", "season", "posteam", "week", "fg_pct_mv", "xp_pct_mv"),
                          ["kicker_name", "kicker_id", "season"], ["season", "posteam", "week"], "games_kicked")
    q = last.where(F.col("games_kicked") >= MIN_GAMES)
    # 5 places: the two engines interpolate quantiles with different (equally
    # exact) formulas, which can differ in the last bit of a difference of two
    return finish(q.agg(F.avg("fg_pct_mv").alias("fg_pct_mv_mean"), F.stddev_samp("fg_pct_mv").alias("fg_pct_mv_sd"),
                        median("xp_pct_mv").alias("xp_pct_mv_median"), iqr("xp_pct_mv").alias("xp_pct_mv_iqr"),
                        F.count(F.lit(1)).alias("n_kicker_seasons")), digits=5)


# ---------------------------------------------------------------- corrected forms (parity=False)

OFF_FIX_SQL = OFF_SQL.replace(
    "coalesce(sum(redzone_epa), 0) AS off_rush_epa, coalesce(sum(pinkzone_epa), 0) AS off_pass_epa",
    "coalesce(sum(CASE WHEN rushpass = 'rush' THEN epa END), 0) AS off_rush_epa, "
    "coalesce(sum(CASE WHEN rushpass = 'pass' THEN epa END), 0) AS off_pass_epa").replace(
    "sum(success_plays) OVER w / nullif(sum(n_plays) OVER w2, 0) AS off_success_rate_ma",
    "sum(success_plays) OVER w / nullif(sum(n_plays) OVER w, 0) AS off_success_rate_ma")
DEF_FIX_SQL = DEF_SQL.replace(
    "sum(success_plays) OVER w / nullif(avg(n_plays) OVER w, 0) AS def_success_rate_ma",
    "sum(success_plays) OVER w / nullif(sum(n_plays) OVER w, 0) AS def_success_rate_ma")
assert OFF_FIX_SQL != OFF_SQL and DEF_FIX_SQL != DEF_SQL


@register("team_week_offense_corrected", OFF_FIX_SQL)
def q_team_week_offense_corrected(spark, sf):
    """W3/W4 + W9 with Q1/Q2 corrected: rush/pass numerators use rush/pass
    EPA, the success rate is a plain season-to-date ratio."""
    return finish(offense_mvavg(season_level(plays(spark, sf)), parity=False))


@register("team_week_defense_corrected", DEF_FIX_SQL)
def q_team_week_defense_corrected(spark, sf):
    """W3/W4 + W9 with Q3 corrected: success rate over the cumulative play count."""
    return finish(defense_mvavg(season_level(plays(spark, sf)), parity=False))
