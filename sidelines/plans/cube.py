"""One pass over the plays for the whole modelling job.

``play_cube`` groups the plays by (season, game_id, posteam, home_team,
defteam, week) - in play-by-play data the last three are fixed by the
team-game, so this is one row per team-game - and computes in the same
aggregation:

* mergeable kicker partials (counts, sums, maxima, the set of kickers, the
  earliest kick and its kicker), the same columns the streaming upkeep
  writes, so ``merge_partials`` turns them into the kicker-game table;
* the conditional sums and counts of the team tables
  (``sidelines.plans.team``), which re-aggregate it by season or week.

Materialised once, it replaces two separate scans of the raw plays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.functions.domain import play_bucket, zone_masks
from sidelines.streaming.incremental import kicker_partial_aggs, kicker_partial_inputs

__all__ = ["CUBE_KEYS", "play_cube"]

CUBE_KEYS = ["season", "game_id", "posteam", "home_team", "defteam", "week"]


def play_cube(plays: DataFrame) -> DataFrame:
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    keep = (((F.col("rush") == 1) | (F.col("pass") == 1) | (F.col("penalty") == 1))
            & (F.col("special_teams_play") == 0))
    z = zone_masks("yardline_100", "epa", "yards_gained")
    fourth = F.when(F.col("down") == 4, 1).when(F.col("down") != 4, 0)
    p = plays.where(F.col("posteam").isNotNull()).select(
        *CUBE_KEYS, *kicker_partial_inputs(), keep.alias("_k"), fourth.alias("fourth_down"),
        *[F.when(keep, F.col(c)).alias(c) for c in ("epa", "success", "yardline_100")],
        *[F.when(keep, v).alias(k) for k, v in z.items()],
        F.when(keep, play_bucket("rush", "pass")).alias("rushpass"),
        F.when(keep, F.col("play_clock").try_cast("double")).alias("pc"),
        F.when(keep, F.col("fourth_down_converted") + F.col("fourth_down_failed")).alias("fd_att"))
    rush, pss = F.col("rushpass") == "rush", F.col("rushpass") == "pass"
    return p.groupBy(*CUBE_KEYS).agg(
        *kicker_partial_aggs(),                  # shared with the streaming upkeep
        # game level
        F.count(F.lit(1)).alias("playcount"), F.count_if(fg == "made").alias("fg_atts"),
        F.count_if(xp == "good").alias("xp_atts"),
        # team tables
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
