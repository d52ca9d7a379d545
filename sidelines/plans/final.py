"""The modelling table: kicker-game rows enriched with everything known
before the game (J4, J2, J8, J9, W17, Q4, Q7, P9).

Every enrichment side is pre-aggregated to one row per key, so the left joins
never multiply rows.  The eight team sides (a season's and its weeks', offence and
defence, the team's own and its opponent's) are one table of a row per
team-season that holds the weeks as a map: it is built once and joined once as
the team, once as the opponent, instead of dealing out the modelling rows for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.text import label
from sidelines.operators.aggregates import scalar
from sidelines.operators.joins import enrich, opponent_role
from sidelines.operators.windows import lagged_cum
from sidelines.plans.context import CONTEXT_COLUMNS, game_context
from sidelines.plans.cube import play_cube
from sidelines.plans.kicker import (KICKER_KEYS, impute_tables, kicker_season_lags, kicker_season_totals,
                                    league_season_lags, season_to_date)
from sidelines.plans.team import DEF_MA_COLS, OFF_MA_COLS, defense_mvavg, offense_mvavg, zone_defense, zone_offense
from sidelines.streaming.incremental import merge_partials
from sidelines.session import cut_lineage

__all__ = ["final_data", "FINAL_COLUMNS"]

ZONE_OFF = ["off_rz_epa", "off_pz_epa", "off_epa", "off_rush_epa", "off_pass_epa", "off_success_rate", "big_play_20_rate",
            "neg_play_5_rate", "mean_play_clock", "fourth_down_try_rate"]
ZONE_DEF = ["def_rz_epa", "def_pz_epa", "def_epa", "def_success_rate", "def_rush_epa", "def_pass_epa"]
#: Columns of the opponent's tables, by the name they get.
OPPONENT_OFF = {"off_epa": "def_off_epa", "off_success_rate": "def_off_success_rate"}
OPPONENT_DEF = {"def_epa": "pos_def_epa", "def_success_rate": "pos_def_success_rate"}
KICKER_SEASON = ["kicker_home", "kicker_szn_max_dist", "kicker_szn_fg_pct", "kicker_szn_xp_pct"]
FINAL_COLUMNS = ["season", "game_id", "posteam", "defteam", "week", "kicker_id", "kicker_name", "total_points",
                 "playcount", "fg_atts", "xp_atts", *KICKER_SEASON, "fg_pct_mv", "xp_pct_mv", "max_dist_mv", "max_made_dist_mv",
                 "szn_kkr_mean_pts", "szn_def_kkr_mean_pts", *ZONE_OFF, *ZONE_DEF, *OFF_MA_COLS, *DEF_MA_COLS,
                 *OPPONENT_OFF.values(), *OPPONENT_DEF.values(), *[f"{c}_ma" for c in OPPONENT_OFF.values()],
                 *[f"{c}_ma" for c in OPPONENT_DEF.values()], *CONTEXT_COLUMNS, "posteam_seas"]


def _weeks(weekly: DataFrame, team: str, cols: list[str], name: str) -> DataFrame:
    """(team, season, name): a team-season's weeks as a map from the week (as many entries as it has games)."""
    rows = weekly.where(F.col(team).isNotNull() & F.col("season").isNotNull() & F.col("week").isNotNull())
    return rows.groupBy(F.col(team).alias("team"), "season").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("week"), F.struct(*cols)))).alias(name))


def team_seasons(cube: DataFrame, parity: bool) -> DataFrame:
    """(team, season, off, def, off_weeks, def_weeks): one row per team-season with its offence, defence and their weeks."""
    def whole(seasonal: DataFrame, team: str, cols: list[str], name: str) -> DataFrame:
        return seasonal.where(F.col(team).isNotNull() & F.col("season").isNotNull()) \
                       .select(F.col(team).alias("team"), "season", F.struct(*cols).alias(name))

    # a team's rows are brought together once for its totals, weeks, windows and fills; one row per game, so a team is small
    offence, defence = cube.repartition("posteam"), cube.where(F.col("defteam").isNotNull()).repartition("defteam")
    out = whole(zone_offense(offence), "posteam", ZONE_OFF, "off")
    for side in (whole(zone_defense(defence), "defteam", ZONE_DEF, "def"), _weeks(offense_mvavg(offence, parity), "posteam", OFF_MA_COLS, "off_weeks"),
                 _weeks(defense_mvavg(defence, parity), "defteam", DEF_MA_COLS, "def_weeks")):
        out = out.join(side, ["team", "season"], "full")
    return out


def with_team_rates(fd: DataFrame, teams: DataFrame) -> DataFrame:
    """The eight team sides of every modelling row, from two joins with :func:`team_seasons`."""
    def ma(names: dict[str, str]) -> dict[str, str]:
        return {f"{a}_ma": f"{b}_ma" for a, b in names.items()}

    def same(cols: list[str]) -> dict[str, str]:
        return {c: c for c in cols}

    sides = {"posteam": {"off": same(ZONE_OFF), "def": OPPONENT_DEF, "off_weeks": same(OFF_MA_COLS), "def_weeks": ma(OPPONENT_DEF)},
             "defteam": {"def": same(ZONE_DEF), "off": OPPONENT_OFF, "def_weeks": same(DEF_MA_COLS), "off_weeks": ma(OPPONENT_OFF)}}
    for team, parts in sides.items():
        fd = fd.join(opponent_role(teams, {"team": team}), [team, "season"], "left")
        found = {x: F.element_at(x, F.col("week")) if x.endswith("_weeks") else F.col(x) for x in parts}
        fd = fd.withColumns({f"_{x}": c for x, c in found.items()})
        fd = fd.withColumns({b: F.col(f"_{x}")[a] for x, names in parts.items() for a, b in names.items()})
        fd = fd.drop(*parts, *[f"_{x}" for x in parts])
    return fd


def final_data(plays: DataFrame, min_games: int = 6, min_attempts: int = 20, first_season=None,
               exclude_weeks: tuple = (), parity: bool = True) -> DataFrame:
    """``first_season`` rows feed the lags but are not modelled;
    ``exclude_weeks`` is a list of (week, season_condition Column) pairs
    dropped at the end (the last-week exclusion, NULL-safe)."""
    # one pass over the raw plays: kicker partials + team sums per team-game
    cube = cut_lineage(play_cube(plays))
    games = cut_lineage(merge_partials(cube.repartition("posteam")))   # small; read by five branches
    imputed = cut_lineage(impute_tables(kicker_season_totals(games, min_attempts)))   # read by four branches
    feats = season_to_date(games, kicker_season_lags(imputed, min_games), league_season_lags(imputed), min_games,
                           with_team=True).drop("n_kkrszn_mv")
    # Q13: fg_atts / xp_atts count *made* kicks, as in the source; names kept
    gl = (cube.where(F.col("defteam").isNotNull()).groupBy("season", "game_id", "posteam", "defteam")
          .agg(F.sum("playcount").alias("playcount"), F.sum("fg_atts").alias("fg_atts"),
               F.sum("xp_atts").alias("xp_atts")))
    base = imputed.select("season", "game_id", "posteam", *KICKER_KEYS, "total_points", *KICKER_SEASON)
    fd = enrich(gl, base, ["season", "game_id", "posteam"], how="right")                       # J4
    fd = enrich(fd, feats, ["season", "game_id", "posteam", *KICKER_KEYS], null_safe=True)      # J2, N4
    overall = scalar(imputed.where(F.col("season") > F.lit(first_season)).agg(F.avg("total_points"))) \
        if first_season is not None else scalar(imputed.agg(F.avg("total_points")))
    fd = fd.withColumns({
        "szn_def_kkr_mean_pts": F.coalesce(lagged_cum("total_points", "mean", ["season", "defteam"],
                                                      ["game_id", "posteam"]), overall),
        "szn_kkr_mean_pts": F.coalesce(lagged_cum("total_points", "mean", ["season", "posteam", *KICKER_KEYS],
                                                  ["game_id"]), overall),
        "week": F.substring("game_id", 9, 2).try_cast("int"),                                   # X5
    })
    fd = with_team_rates(fd, cut_lineage(team_seasons(cube, parity)))                              # J8, J9
    fd = fd.join(game_context(games), ["game_id", "posteam"], "left")
    fd = fd.withColumns({
        "total_points": F.when((F.col("fg_atts") == 0) & (F.col("xp_atts") == 0), F.lit(0))
                         .otherwise(F.col("total_points")),                                       # Q4
        "posteam_seas": label("posteam", "season", sep="_")})                                     # P9
    if first_season is not None:
        fd = fd.where(F.col("season") > F.lit(first_season))
    for week, cond in exclude_weeks:                                                              # F4 / Q7
        fd = fd.where(~((F.col("week") == week) & cond))
    return fd.select(*FINAL_COLUMNS)
