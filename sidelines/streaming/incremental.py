"""Kicker-game facts kept up to date as new event files arrive.

Each micro-batch of events is reduced to *mergeable* partial facts per
team-game (counts, sums, maxima, the set of kickers, the earliest kick and
its kicker) and appended to a partials table, one folder per batch id
(rewritten on retry, so the sink is idempotent).  Merging all partials
with a second aggregation gives exactly the team-game table of the batch job
(``sidelines.plans.kicker.kicker_games``), so the season-to-date features
can be recomputed from a small table without rescanning old plays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.functions.domain import kick_points, made_distance
from sidelines.functions.nulls import if_na
from sidelines.operators.windows import fill
from sidelines.plans.adapter import plays_from_events
from sidelines.plans.kicker import GAME_KEYS, KICKER_KEYS

__all__ = ["EVENTS_SCHEMA", "kicker_partial_inputs", "kicker_partial_aggs", "partial_facts", "merge_partials",
           "start_facts_stream"]

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def kicker_partial_inputs() -> list:
    """Per-play columns the kicker partials aggregate (kick rows only)."""
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    kick = fg.isNotNull() | xp.isNotNull()
    return [fg, xp, kick.alias("_kick"),
            F.when(kick, kick_points(fg, "kick_distance", xp)).alias("kick_fp"),
            F.when(kick, F.col("kick_distance")).alias("kdist"),
            made_distance(fg, xp, "kick_distance").alias("kmd"),
            F.when(kick, F.col("kicker_player_id")).alias("kid"),
            F.when(kick, F.col("kicker_player_name")).alias("kname"),
            F.when(kick, F.col("play_id")).alias("kord")]


def kicker_partial_aggs() -> list:
    """Mergeable aggregates over ``kicker_partial_inputs`` (sums, maxima,
    the kicker set and the earliest kick with its kicker)."""
    fg, xp = F.col("field_goal_result"), F.col("extra_point_result")
    return [F.count_if("_kick").alias("n_kick"), F.sum("kick_fp").alias("points"),
            F.count_if(fg == "made").alias("n_fg"), F.count(fg).alias("n_fg_att"),
            F.count_if(xp == "good").alias("n_xp"), F.count(xp).alias("n_xp_att"),
            F.max("kdist").alias("max_dist"), F.max("kmd").alias("max_made_dist"),
            F.collect_set("kid").alias("kickers"),
            F.max(F.when(F.col("_kick"), F.col("kid").isNull().cast("int"))).alias("null_kicker"),
            F.min("kord").alias("first_ord"),
            F.min_by("kid", "kord").alias("first_kid"), F.min_by("kname", "kord").alias("first_kname")]


def partial_facts(plays: DataFrame) -> DataFrame:
    """Mergeable per-team-game partial aggregates of a batch of plays."""
    p = plays.where(F.col("posteam").isNotNull()).select(*GAME_KEYS, *kicker_partial_inputs())
    return p.groupBy(*GAME_KEYS).agg(*kicker_partial_aggs())


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine partial facts into the team-game table (spine, F7 filter,
    kicker filled down then up), identical to the batch job's result."""
    g = partials.groupBy(*GAME_KEYS).agg(
        F.sum("n_kick").alias("_n_kick"), F.coalesce(F.sum("points"), F.lit(0)).alias("total_points"),
        F.sum("n_fg").alias("n_fg"), F.sum("n_fg_att").alias("n_fg_att"),
        F.sum("n_xp").alias("n_xp"), F.sum("n_xp_att").alias("n_xp_att"),
        F.max("max_dist").alias("max_dist"), F.max("max_made_dist").alias("max_made_dist"),
        F.array_distinct(F.flatten(F.collect_list("kickers"))).alias("_k"), F.max("null_kicker").alias("_nk"),
        F.min_by("first_kid", "first_ord").alias("kicker_id"), F.min_by("first_kname", "first_ord").alias("kicker_name"))
    g = g.withColumns({
        "kickers_per_team": F.when(F.col("_n_kick") > 0, F.size("_k") + F.col("_nk")).cast("long"),
        "max_made_dist": F.when(~((F.col("n_fg") == 0) & (F.col("n_xp") == 0)), F.col("max_made_dist")),
        "kicker_home": if_na(F.col("posteam") == F.col("home_team"), 1, 0),
    })
    g = g.where((F.col("kickers_per_team") == 1) | F.col("kickers_per_team").isNull())
    g = g.select(*GAME_KEYS, "total_points", "n_fg", "n_fg_att", "n_xp", "n_xp_att", "max_dist", "max_made_dist",
                 "kickers_per_team", "kicker_id", "kicker_name", "kicker_home")
    return fill(g, ["posteam", "season"], ["game_id"], KICKER_KEYS, "downup")


def start_facts_stream(spark: SparkSession, source_dir: str, partials_dir: str, checkpoint_location: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    """Stream new event files into the partials table; returns the query."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        partial_facts(plays_from_events(batch)).write.mode("overwrite") \
            .parquet(f"{partials_dir.rstrip('/')}/batch_id={batch_id}")

    w = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
