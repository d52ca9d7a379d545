"""Team offence / defence tables: full-season (leaky, kept as a labelled
alternative) and season-to-date per week (the modelling features), with the
role swaps that turn an offence table into an opponent table (J9, P2).

All windows run on team-week rows (plays pre-aggregated per team-week).
``parity=True`` reproduces three quirks of the source computation:
Q1 weekly rush/pass EPA numerators sum the red-zone / pink-zone EPA;
Q2 the success rate divides by an already lagged count and is lagged again;
Q3 the defensive success rate divides by a cumulative mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.domain import play_bucket, zone_masks
from sidelines.functions.nulls import rate
from sidelines.operators.joins import opponent_role
from sidelines.operators.windows import fill, lagged_cum, season_to_date_ratio

__all__ = ["season_level", "zone_offense", "zone_defense", "offense_mvavg", "defense_mvavg",
           "def_off", "pos_def", "OFF_MA_COLS", "DEF_MA_COLS"]


def season_level(plays: DataFrame) -> DataFrame:
    """One pass over the plays: a cube of conditional sums and counts per
    (season, posteam, defteam, week, game_id) - the game is fixed by the
    team-week, so the key adds no rows.  It also carries the game-level
    counts (all plays, made field goals, good extra points).  Scrimmage plays (run, pass or
    penalty, not special teams) feed the statistics; ``fd_all`` counts
    fourth downs over *all* plays of the team, taken before that filter
    (Q19).  Every team table below re-aggregates this small cube, so the raw
    plays are scanned once however many tables are built."""
    keep = (((F.col("rush") == 1) | (F.col("pass") == 1) | (F.col("penalty") == 1))
            & (F.col("special_teams_play") == 0))
    z = zone_masks("yardline_100", "epa", "yards_gained")
    bucket = play_bucket("rush", "pass")
    fourth = F.when(F.col("down") == 4, 1).when(F.col("down") != 4, 0)
    p = plays.where(F.col("posteam").isNotNull()).select(
        "season", "posteam", "defteam", "week", "game_id", keep.alias("_k"), fourth.alias("fourth_down"),
        (F.col("field_goal_result") == "made").alias("_fgm"), (F.col("extra_point_result") == "good").alias("_xpg"),
        *[F.when(keep, F.col(c)).alias(c) for c in ("epa", "success", "yardline_100")],
        *[F.when(keep, v).alias(k) for k, v in z.items()],
        F.when(keep, bucket).alias("rushpass"),
        F.when(keep, F.col("play_clock").try_cast("double")).alias("pc"),
        F.when(keep, F.col("fourth_down_converted") + F.col("fourth_down_failed")).alias("fd_att"))
    rush, pss = F.col("rushpass") == "rush", F.col("rushpass") == "pass"
    return p.groupBy("season", "posteam", "defteam", "week", "game_id").agg(
        F.count(F.lit(1)).alias("playcount"), F.count_if("_fgm").alias("fg_atts"), F.count_if("_xpg").alias("xp_atts"),
        F.count_if("_k").alias("n"), F.sum("fourth_down").alias("fd_all"),
        F.sum(F.when(F.col("_k"), F.col("fourth_down"))).alias("fd_keep"),
        F.sum("redzone_epa").alias("rz_s"), F.count("redzone_epa").alias("rz_n"),
        F.sum("pinkzone_epa").alias("pz_s"), F.count("pinkzone_epa").alias("pz_n"),
        F.sum("epa").alias("epa_s"), F.count("epa").alias("epa_n"),
        F.sum(F.when(rush, F.col("epa"))).alias("rush_s"), F.count(F.when(rush, F.col("epa"))).alias("rush_en"),
        F.sum(F.when(pss, F.col("epa"))).alias("pass_s"), F.count(F.when(pss, F.col("epa"))).alias("pass_en"),
        F.count_if(rush).alias("n_rush"), F.count_if(pss).alias("n_pass"),
        F.sum("success").alias("succ_s"), F.sum("big_play_20").alias("big_s"), F.sum("neg_play_5").alias("neg_s"),
        F.sum("pc").alias("pc_s"), F.count("pc").alias("pc_n"),
        F.count_if(F.col("yardline_100") >= 20).alias("n_20"), F.count_if(F.col("yardline_100") <= 95).alias("n_5"),
        F.sum("fd_att").alias("fd_att"))


def _sum0(c):
    return F.coalesce(F.sum(c), F.lit(0))


def zone_offense(cube: DataFrame) -> DataFrame:
    """Full-season offence per (posteam, season) (leaky: kept as a labelled
    alternative)."""
    g = cube.groupBy("posteam", "season").agg(*[F.sum(c).alias(c) for c in (
        "n", "fd_all", "rz_s", "rz_n", "pz_s", "pz_n", "epa_s", "epa_n", "rush_s", "rush_en", "pass_s", "pass_en",
        "succ_s", "big_s", "neg_s", "pc_s", "pc_n", "fd_att")]).where(F.col("n") > 0)
    out = g.select(
        "posteam", "season",
        rate("rz_s", "rz_n").alias("off_rz_epa"), rate("pz_s", "pz_n").alias("off_pz_epa"),
        rate("epa_s", "epa_n").alias("off_epa"), rate("rush_s", "rush_en").alias("off_rush_epa"),
        rate("pass_s", "pass_en").alias("off_pass_epa"),
        rate(F.coalesce("succ_s", F.lit(0)), "n").alias("off_success_rate"),
        rate(F.coalesce("big_s", F.lit(0)), "n").alias("big_play_20_rate"),
        rate(F.coalesce("neg_s", F.lit(0)), "n").alias("neg_play_5_rate"),
        rate("pc_s", "pc_n").alias("mean_play_clock"),
        F.col("fd_all").alias("fourth_down_n"), F.coalesce("fd_att", F.lit(0)).alias("fourth_down_att"))
    return out.withColumn("fourth_down_try_rate", rate("fourth_down_att", "fourth_down_n"))


def zone_defense(cube: DataFrame) -> DataFrame:
    """Full-season defence per (defteam, season)."""
    g = cube.groupBy("defteam", "season").agg(*[F.sum(c).alias(c) for c in (
        "n", "rz_s", "rz_n", "pz_s", "pz_n", "epa_s", "epa_n", "rush_s", "rush_en", "pass_s", "pass_en",
        "succ_s")]).where(F.col("n") > 0)
    return g.select(
        "defteam", "season", rate("rz_s", "rz_n").alias("def_rz_epa"), rate("pz_s", "pz_n").alias("def_pz_epa"),
        rate("epa_s", "epa_n").alias("def_epa"), F.col("n").alias("n_plays"),
        rate(F.coalesce("succ_s", F.lit(0)), "n").alias("def_success_rate"),
        rate("rush_s", "rush_en").alias("def_rush_epa"), rate("pass_s", "pass_en").alias("def_pass_epa"))


OFF_MA_COLS = ["off_rz_epa_ma", "off_pz_epa_ma", "off_epa_ma", "off_rush_epa_ma", "off_pass_epa_ma",
               "big_play_20_rate_ma", "neg_play_5_rate_ma", "mean_play_clock_ma", "fourth_down_try_rate_ma",
               "off_success_rate_ma"]
DEF_MA_COLS = ["def_rz_epa_ma", "def_pz_epa_ma", "def_epa_ma", "def_rush_epa_ma", "def_pass_epa_ma",
               "def_success_rate_ma"]


def offense_mvavg(cube: DataFrame, parity: bool = False) -> DataFrame:
    """Season-to-date offence per (posteam, season, week), forward-filled
    within the team across seasons."""
    wk = cube.groupBy("season", "posteam", "week").agg(
        F.sum("n").alias("n_plays"), _sum0("rz_s").alias("off_rz_epa"), _sum0("pz_s").alias("off_pz_epa"),
        F.sum("rz_n").alias("n_off_rz"), F.sum("pz_n").alias("n_off_pz"),
        (_sum0("rz_s") if parity else _sum0("rush_s")).alias("off_rush_epa"),
        (_sum0("pz_s") if parity else _sum0("pass_s")).alias("off_pass_epa"),
        _sum0("epa_s").alias("off_epa"), _sum0("succ_s").alias("success_plays"),
        F.sum("n_20").alias("n_plays_20"), F.sum("n_5").alias("n_plays_5"),
        F.sum("n_rush").alias("n_off_rush"), F.sum("n_pass").alias("n_off_pass"),
        _sum0("big_s").alias("big_play_20_n"), _sum0("neg_s").alias("neg_play_5_n"),
        _sum0("pc_s").alias("sum_play_clock"), _sum0("fd_keep").alias("fourth_down_n"),
        _sum0("fd_att").alias("fourth_down_att")).where(F.col("n_plays") > 0)
    K, O = ["posteam", "season"], ["week"]          # the order of the fill below: sorted once

    def r(num, den):
        return season_to_date_ratio(num, den, K, O)
    if parity:   # lag(cumsum(s) / lag(cumsum(n))): numerator to t-1, denominator to t-2
        w2 = Window.partitionBy(*K).orderBy(*O).rowsBetween(Window.unboundedPreceding, -2)
        success = F.try_divide(lagged_cum("success_plays", "sum", K, O), F.sum("n_plays").over(w2))
    else:
        success = r("success_plays", "n_plays")
    wk = wk.withColumns({
        "off_rz_epa_ma": r("off_rz_epa", "n_off_rz"), "off_pz_epa_ma": r("off_pz_epa", "n_off_pz"),
        "off_rush_epa_ma": r("off_rush_epa", "n_off_rush"), "off_pass_epa_ma": r("off_pass_epa", "n_off_pass"),
        "off_epa_ma": r("off_epa", "n_plays"), "off_success_rate_ma": success,
        "big_play_20_rate_ma": r("big_play_20_n", "n_plays_20"), "neg_play_5_rate_ma": r("neg_play_5_n", "n_plays_5"),
        "mean_play_clock_ma": r("sum_play_clock", "n_plays"),
        "fourth_down_try_rate_ma": r("fourth_down_att", "fourth_down_n")})
    wk = fill(wk, ["posteam"], ["season", "week"], OFF_MA_COLS, "down")
    return wk.select("posteam", "season", "week", *OFF_MA_COLS)


def defense_mvavg(cube: DataFrame, parity: bool = False) -> DataFrame:
    """Season-to-date defence per (defteam, season, week)."""
    wk = cube.groupBy("season", "defteam", "week").agg(
        F.sum("n").alias("n_plays"), _sum0("rz_s").alias("def_rz_epa"), _sum0("pz_s").alias("def_pz_epa"),
        _sum0("epa_s").alias("def_epa"), F.sum("rz_n").alias("n_def_rz"), F.sum("pz_n").alias("n_def_pz"),
        _sum0("rush_s").alias("def_rush_epa"), _sum0("pass_s").alias("def_pass_epa"),
        F.sum("n_rush").alias("n_def_rush"), F.sum("n_pass").alias("n_def_pass"),
        _sum0("succ_s").alias("success_plays")).where(F.col("n_plays") > 0)
    K, O = ["defteam", "season"], ["week"]

    def r(num, den):
        return season_to_date_ratio(num, den, K, O)
    success = (F.try_divide(lagged_cum("success_plays", "sum", K, O), lagged_cum("n_plays", "mean", K, O))
               if parity else r("success_plays", "n_plays"))
    wk = wk.withColumns({
        "def_rz_epa_ma": r("def_rz_epa", "n_def_rz"), "def_pz_epa_ma": r("def_pz_epa", "n_def_pz"),
        "def_epa_ma": r("def_epa", "n_plays"), "def_rush_epa_ma": r("def_rush_epa", "n_def_rush"),
        "def_pass_epa_ma": r("def_pass_epa", "n_def_pass"), "def_success_rate_ma": success})
    wk = fill(wk, ["defteam"], ["season", "week"], DEF_MA_COLS, "down")
    return wk.select("defteam", "season", "week", *DEF_MA_COLS)


def def_off(zo: DataFrame) -> DataFrame:
    """A team's offence seen as its opponents' defence context."""
    return opponent_role(zo.select("posteam", "season", "off_epa", "off_success_rate"),
                         {"off_epa": "def_off_epa", "posteam": "defteam", "off_success_rate": "def_off_success_rate"})


def pos_def(zd: DataFrame) -> DataFrame:
    return opponent_role(zd.select("defteam", "season", "def_epa", "def_success_rate"),
                         {"def_epa": "pos_def_epa", "defteam": "posteam", "def_success_rate": "pos_def_success_rate"})
