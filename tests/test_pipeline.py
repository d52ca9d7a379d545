"""Properties of the end-to-end play pipeline on the smallest tables."""
from pyspark.sql import functions as F

from sidelines.plans.adapter import plays_from_events
from sidelines.plans.final import final_data
from sidelines.plans.kicker import kicker_games
from sidelines.plans.team import defense_mvavg, offense_mvavg, season_level

SF = "/root/testdata/sf0.001"


def _plays(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return plays_from_events(spark.read.parquet(f"{SF}/events.parquet"))


def test_enrichment_joins_never_multiply_rows(spark):
    p = _plays(spark)
    fd = final_data(p, 3, 5)
    games = kicker_games(p)
    assert fd.count() == games.count()
    assert fd.select("season", "game_id", "posteam").distinct().count() == fd.count()


def test_team_week_features_ignore_later_weeks(spark):
    """Week w's season-to-date features use weeks < w only: dropping every
    play after a cut week leaves the earlier weeks' features unchanged."""
    p = _plays(spark)
    cut = 10
    full = offense_mvavg(season_level(p), parity=True).where(F.col("week") <= cut)
    part = offense_mvavg(season_level(p.where(F.col("week") <= cut)), parity=True)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(full.collect(), key=key) == sorted(part.collect(), key=key)
    dfull = defense_mvavg(season_level(p), parity=False).where(F.col("week") <= cut)
    dpart = defense_mvavg(season_level(p.where(F.col("week") <= cut)), parity=False)
    assert sorted(dfull.collect(), key=key) == sorted(dpart.collect(), key=key)


def test_kick_less_team_games_survive_and_multi_kicker_games_drop(spark):
    p = _plays(spark)
    g = kicker_games(p)
    assert g.where(F.col("kickers_per_team").isNull()).count() >= 0
    assert g.where(F.col("kickers_per_team") > 1).count() == 0
    spine = p.where(F.col("posteam").isNotNull()).select("season", "game_id", "posteam").distinct().count()
    multi = (p.where(F.col("kicker_player_id").isNotNull()).groupBy("season", "game_id", "posteam")
             .agg(F.count_distinct("kicker_player_id").alias("k")).where("k > 1").count())
    assert g.count() == spine - multi
