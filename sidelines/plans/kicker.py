"""Kicker points pipeline: plays -> kicker-game facts -> imputation tables ->
leakage-free season-to-date features with a minimum-sample fallback chain.

Every step is a lazy DataFrame; the windows run on pre-aggregated
team-game rows (one per team and game), never on raw plays, so a busy team or
kicker is reduced map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelines.functions.domain import kick_points, made_distance
from sidelines.functions.nulls import if_na, rate
from sidelines.operators.aggregates import median
from sidelines.operators.joins import enrich
from sidelines.session import cut_lineage
from sidelines.operators.windows import (fallback_chain, fill, lagged_cum, season_lag,
                                         season_to_date_ratio, suppress_small)

__all__ = ["GAME_KEYS", "KICKER_KEYS", "kicker_games", "kicker_season_totals", "impute_tables",
           "kicker_season_lags", "league_season_lags", "season_to_date", "kicker_features",
           "features_from_games"]

GAME_KEYS = ["season", "game_id", "posteam", "home_team"]
KICKER_KEYS = ["kicker_name", "kicker_id"]
COUNT_COLS = ["n_fg", "n_fg_att", "n_xp", "n_xp_att", "total_points"]


def kicker_games(plays: DataFrame) -> DataFrame:
    """Kicker-game facts on the team-game spine.

    Team-games without a kick survive with zero counts; team-games where more
    than one kicker kicked are dropped; the kicker of kick-less games is filled
    down then up within the team-season.

    Spine and facts come from one conditional aggregation over the plays:
    every play with a team defines its team-game (the spine), only kick plays
    feed the kick columns, so kick-less team-games get zero counts and NULL
    kicker columns, exactly like a spine left join.  One scan, one partially
    aggregated shuffle; distinct kickers are a per-game set (a handful)."""
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    kick = fg.isNotNull() | xp.isNotNull()
    p = plays.where(F.col("posteam").isNotNull()).select(
        *GAME_KEYS, fg, xp, kick.alias("_kick"),
        F.when(kick, kick_points(fg, "kick_distance", xp)).alias("kick_fp"),
        F.when(kick, F.col("kick_distance")).alias("kdist"),
        made_distance(fg, xp, "kick_distance").alias("kick_made_distance"),
        F.when(kick, F.col("kicker_player_id")).alias("kid"),
        F.when(kick, F.col("kicker_player_name")).alias("kname"),
        F.when(kick, F.col("play_id")).alias("kord"))
    games = p.groupBy(*GAME_KEYS).agg(
        F.count_if("_kick").alias("_n_kick"),
        F.coalesce(F.sum("kick_fp"), F.lit(0)).alias("total_points"),
        F.count_if(fg == "made").alias("n_fg"),
        F.count(fg).alias("n_fg_att"),
        F.count_if(xp == "good").alias("n_xp"),
        F.count(xp).alias("n_xp_att"),
        F.max("kdist").alias("max_dist"),
        F.max("kick_made_distance").alias("max_made_dist"),
        (F.size(F.collect_set("kid")) + F.max(F.when(F.col("_kick"), F.col("kid").isNull().cast("int"))))
        .alias("_kpt"),
        F.min_by("kid", "kord").alias("kicker_id"),
        F.min_by("kname", "kord").alias("kicker_name"),
    )
    games = games.withColumns({
        "kickers_per_team": F.when(F.col("_n_kick") > 0, F.col("_kpt")).cast("long"),
        "max_made_dist": F.when(~((F.col("n_fg") == 0) & (F.col("n_xp") == 0)), F.col("max_made_dist")),
        "kicker_home": if_na(F.col("posteam") == F.col("home_team"), 1, 0),
    }).drop("_n_kick", "_kpt")
    games = games.where((F.col("kickers_per_team") == 1) | F.col("kickers_per_team").isNull())
    games = games.select(*GAME_KEYS, "total_points", "n_fg", "n_fg_att", "n_xp", "n_xp_att", "max_dist",
                         "max_made_dist", "kickers_per_team", "kicker_id", "kicker_name", "kicker_home")
    return fill(games, ["posteam", "season"], ["game_id"], KICKER_KEYS, "downup")


def kicker_season_totals(games: DataFrame, min_attempts: int = 20) -> DataFrame:
    """Kicker-season totals attached to every kicker-game, plus rates and
    the qualified-sample flag (``enough_kicks``)."""
    keys = ["season", *KICKER_KEYS]
    tot = games.groupBy(*keys).agg(
        F.sum("n_fg").alias("kicker_szn_fg_made"), F.sum("n_fg_att").alias("kicker_szn_fg_att"),
        F.sum("n_xp").alias("kicker_szn_xp_made"), F.sum("n_xp_att").alias("kicker_szn_xp_att"),
        F.max("max_dist").alias("kicker_szn_max_dist"),
        F.max("max_made_dist").alias("kicker_szn_max_made_dist"))
    out = enrich(games, tot, keys, "left", null_safe=True)
    made0 = (F.col("kicker_szn_fg_made") == 0) & (F.col("kicker_szn_xp_made") == 0)
    enough = (F.col("kicker_szn_fg_att") >= min_attempts) & (F.col("kicker_szn_xp_att") >= min_attempts)
    return out.withColumns({
        "kicker_szn_fg_pct": rate("kicker_szn_fg_made", "kicker_szn_fg_att"),
        "kicker_szn_xp_pct": rate("kicker_szn_xp_made", "kicker_szn_xp_att"),
        "kicker_szn_max_made_dist": F.when(~made0, F.col("kicker_szn_max_made_dist")),
        "enough_kicks": if_na(enough, True, False),
    })


def impute_tables(kicks: DataFrame) -> DataFrame:
    """A11 + W15: season medians of qualified kickers' distances, league rates
    (games-weighted, Q5), and the imputed kicker-season values."""
    q = (kicks.where(F.col("enough_kicks"))
         .groupBy("season", *KICKER_KEYS)
         .agg(F.avg("kicker_szn_max_dist").alias("d"), F.avg("kicker_szn_max_made_dist").alias("md")))
    # one row per kicker-season here (entity-level), so the built-in exact
    # percentile's per-group value map is bounded by the kickers of a season,
    # not by raw rows; the skew-safe ``quantiles`` operator costs several extra
    # stages per median over this lineage (measured 3x slower) for no gain
    meds = q.groupBy("season").agg(median("d").alias("max_dist_to_impute"),
                                   median("md").alias("max_made_dist_to_impute"))
    grp = kicks.groupBy("season").agg(
        rate(F.sum("kicker_szn_fg_made"), F.sum("kicker_szn_fg_att")).alias("group_szn_fg_pct"),
        rate(F.sum("kicker_szn_xp_made"), F.sum("kicker_szn_xp_att")).alias("group_szn_xp_pct"))
    out = kicks.join(meds, "season", "left").join(grp, "season", "left")
    e = F.col("enough_kicks")

    def pick(own, other):
        return F.when(e, F.col(own)).when(~e, F.col(other))
    return out.withColumns({
        "kicker_szn_fg_pct": pick("kicker_szn_fg_pct", "group_szn_fg_pct"),
        "kicker_szn_xp_pct": pick("kicker_szn_xp_pct", "group_szn_xp_pct"),
        "kicker_szn_max_dist": pick("kicker_szn_max_dist", "max_dist_to_impute"),
        "kicker_szn_max_made_dist": pick("kicker_szn_max_made_dist", "max_made_dist_to_impute"),
    })


def kicker_season_lags(imputed: DataFrame, min_games: int = 6) -> DataFrame:
    """W16 + W2: kicker-season means with small samples suppressed, lagged one
    season within the kicker."""
    ks = imputed.groupBy(*KICKER_KEYS, "season").agg(
        F.avg("kicker_szn_fg_pct").alias("fg"), F.avg("kicker_szn_xp_pct").alias("xp"),
        F.max("kicker_szn_max_dist").alias("md"), F.max("kicker_szn_max_made_dist").alias("mmd"),
        F.count(F.lit(1)).alias("games"))
    ks = ks.withColumns({c: suppress_small(c, "games", min_games) for c in ["fg", "xp", "md", "mmd"]})
    w = Window.partitionBy(*KICKER_KEYS).orderBy("season")
    return ks.select(*KICKER_KEYS, "season",
                     F.lag("fg").over(w).alias("sznlag_kicker_szn_fg_pct"),
                     F.lag("xp").over(w).alias("sznlag_kicker_szn_xp_pct"),
                     F.lag("md").over(w).alias("sznlag_kicker_szn_max_dist"),
                     F.lag("mmd").over(w).alias("sznlag_kicker_szn_max_made_dist"))


def league_season_lags(imputed: DataFrame) -> DataFrame:
    """League-season rates and medians of the previous season (W2 over a
    table with one row per season)."""
    per = imputed.withColumns({
        "kicker_szn_max_dist": F.max("kicker_szn_max_dist").over(Window.partitionBy(*KICKER_KEYS, "season")),
        "kicker_szn_max_made_dist": F.max("kicker_szn_max_made_dist").over(
            Window.partitionBy(*KICKER_KEYS, "season"))})
    sz = per.groupBy("season").agg(
        rate(F.sum("n_fg"), F.sum("n_fg_att")).alias("szn_fg_pct"),
        rate(F.sum("n_xp"), F.sum("n_xp_att")).alias("szn_xp_pct"),
        median("kicker_szn_max_dist").alias("szn_max_dist"),
        median("kicker_szn_max_made_dist").alias("szn_max_made_dist"))
    return season_lag(sz, [], ["season"], ["szn_fg_pct", "szn_xp_pct", "szn_max_dist", "szn_max_made_dist"]) \
        .select("season", "lag_szn_fg_pct", "lag_szn_xp_pct", "lag_szn_max_dist", "lag_szn_max_made_dist")


def season_to_date(games: DataFrame, kicker_lags: DataFrame, league_lags: DataFrame,
                   min_games: int = 6, with_team: bool = False) -> DataFrame:
    """Season-to-date kicker rates and distances; fewer than
    ``min_games`` prior games falls back to last season's own value, then the
    league's."""
    keys = [*KICKER_KEYS, "season"]
    order = ["game_id"]
    g = games.select(*keys, "game_id", "posteam", "n_fg", "n_fg_att", "n_xp", "n_xp_att", "max_dist", "max_made_dist")
    g = g.withColumns({
        "max_dist": F.when(F.col("max_dist").isNull() & (F.col("n_fg_att") == 0) & (F.col("n_xp_att") == 0),
                           F.lit(0.0)).otherwise(F.col("max_dist")),
        "max_made_dist": F.when(F.col("max_made_dist").isNull() & (F.col("n_fg") == 0) & (F.col("n_xp") == 0),
                                F.lit(0.0)).otherwise(F.col("max_made_dist")),
    })
    g = g.withColumns({
        "fg_pct_mv": season_to_date_ratio("n_fg", "n_fg_att", keys, order),
        "xp_pct_mv": season_to_date_ratio("n_xp", "n_xp_att", keys, order),
        "max_dist_mv": lagged_cum("max_dist", "max", keys, order, na="poison"),
        "max_made_dist_mv": lagged_cum("max_made_dist", "max", keys, order, na="poison"),
        "n_kkrszn_mv": lagged_cum("kicker_name", "count", keys, order),
    })
    g = enrich(g, kicker_lags, keys, "left", null_safe=True).join(league_lags, "season", "left")
    n = F.col("n_kkrszn_mv")
    return g.select(
        *KICKER_KEYS, "season", "game_id", *(["posteam"] if with_team else []), "n_kkrszn_mv",
        fallback_chain("fg_pct_mv", n, min_games, "sznlag_kicker_szn_fg_pct", "lag_szn_fg_pct").alias("fg_pct_mv"),
        fallback_chain("xp_pct_mv", n, min_games, "sznlag_kicker_szn_xp_pct", "lag_szn_xp_pct").alias("xp_pct_mv"),
        fallback_chain("max_dist_mv", n, min_games, "sznlag_kicker_szn_max_dist", "lag_szn_max_dist")
        .alias("max_dist_mv"),
        fallback_chain("max_made_dist_mv", n, min_games, "sznlag_kicker_szn_max_made_dist",
                       "lag_szn_max_made_dist").alias("max_made_dist_mv"),
    )


def kicker_features(plays: DataFrame, min_games: int = 6, min_attempts: int = 20,
                    materialize: bool = True) -> DataFrame:
    """The whole season-to-date kicker feature job.

    The team-game table feeds five branches (season totals, imputation,
    kicker lags, league lags, season-to-date windows).  It is a reduction of
    the plays by orders of magnitude, so it is written once to the shared
    checkpoint folder and every branch reads it, instead of each branch
    rescanning and re-aggregating the raw plays."""
    games = kicker_games(plays)
    if materialize:
        games = cut_lineage(games)
    return features_from_games(games, min_games, min_attempts)


def features_from_games(games: DataFrame, min_games: int = 6, min_attempts: int = 20) -> DataFrame:
    """Season-to-date features from an (ideally materialised) team-game table."""
    kicks = kicker_season_totals(games, min_attempts)
    imputed = impute_tables(kicks)
    return season_to_date(games, kicker_season_lags(imputed, min_games), league_season_lags(imputed), min_games)
