"""Feature sets (M1) and resampling folds (M2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.operators.aggregates import quantiles
from sidelines.operators.windows import global_row_number

__all__ = ["FEATURE_SETS", "stratified_folds"]

# Named predictor sets of the kicker model (M1), in the modelling table's column
# names (fixed values; ``season_num`` counts seasons).  "full" has full-season rates, which see the
# game being predicted (kept as the labelled leaky alternative, like the
# source); "with_final_score" has the score, outcome information.
_ODDS = ["pos_imptot", "def_imptot", "pos_imptotdiff"]
_PLACE = ["szn_def_kkr_mean_pts", "szn_kkr_mean_pts", "roof_closed", "roof_dome", "roof_open", "wind_weather", "precipitation_unknown",
          "precipitation_yes"]
_KICKER_MA = ["week", "season_num", "max_dist_mv", "kicker_home", "fg_pct_mv", "xp_pct_mv"]
FEATURE_SETS = {
    "season_to_date": _ODDS + _KICKER_MA + [
        "off_epa_ma", "off_rz_epa_ma", "off_pz_epa_ma", "off_rush_epa_ma", "off_pass_epa_ma",
        "def_epa_ma", "def_rz_epa_ma", "def_pz_epa_ma", "def_rush_epa_ma", "def_pass_epa_ma",
        "pos_def_epa_ma", "def_off_epa_ma",
        "off_success_rate_ma", "def_success_rate_ma", "pos_def_success_rate_ma", "def_off_success_rate_ma",
        "big_play_20_rate_ma", "neg_play_5_rate_ma", "fourth_down_try_rate_ma"] + _PLACE,
    "small": _ODDS[:2] + _KICKER_MA + ["fourth_down_try_rate_ma"] + _PLACE,
    "full": _ODDS + ["week", "season_num", "kicker_szn_max_dist", "kicker_home", "kicker_szn_fg_pct", "kicker_szn_xp_pct",
                     "off_epa", "off_rz_epa", "off_pz_epa", "off_rush_epa", "off_pass_epa",
                     "def_epa", "def_rz_epa", "def_pz_epa", "def_rush_epa", "def_pass_epa",
                     "big_play_20_rate", "neg_play_5_rate", "fourth_down_try_rate",
                     "off_success_rate", "def_success_rate", "pos_def_success_rate", "def_off_success_rate"] + _PLACE,
    "with_final_score": ["pos_score", "def_score"] + _KICKER_MA + ["fourth_down_try_rate_ma"] + _PLACE,
}


def stratified_folds(df: DataFrame, strata: str, v: int = 10, key: str | Sequence[str] = "id",
                     seed: int | None = None, fold_col: str = "fold", quartiles: bool = False) -> DataFrame:
    """M2: v-fold assignment stratified on ``strata``.

    Strata are the distinct values (NULL is one), or with ``quartiles=True``
    the exact quartile bins of a numeric column (skew-safe operator).  Within
    a stratum rows are numbered in ``key`` order (or a seeded hash order) and
    dealt round-robin, so fold sizes differ by at most one per stratum.  The
    numbering is range-partitioned: a stratum holding a large share of all
    rows is never funnelled through one task.  Folds are 0-based (as
    ``CrossValidator(foldCol=...)`` expects)."""
    keys = [key] if isinstance(key, str) else list(key)
    if not quartiles:
        s = df.withColumn("_stratum", F.col(strata).cast("string"))
    else:
        q = quantiles(df, [], strata, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.struct("q1", "q2", "q3")).scalar()
        b = (F.when(F.col(strata).isNull(), F.lit(None)).when(F.col(strata) <= q["q1"], 1).when(F.col(strata) <= q["q2"], 2)
             .when(F.col(strata) <= q["q3"], 3).otherwise(4))
        s = df.withColumn("_stratum", b.cast("string"))
    order = keys if seed is None else ["_h", *keys]
    if seed is not None:
        s = s.withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    out = global_row_number(s, order, "_rn", keys=["_stratum"])
    out = out.withColumn(fold_col, ((F.col("_rn") - 1) % v).cast("int"))
    return out.drop("_rn", "_stratum", *(["_h"] if seed is not None else []))
