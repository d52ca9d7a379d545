"""Domain rubrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_, if_na, is_in

__all__ = ["kick_points", "made_distance", "zone_masks", "play_bucket", "implied_totals",
           "by_role", "goal_to_go", "FG_RESULTS_MISS", "XP_RESULTS_MISS", "UNCLASSIFIED_KICK"]

# Fixed values of the kick-points rubric.
FG_RESULTS_MISS = ("missed", "blocked")
XP_RESULTS_MISS = ("failed", "blocked")
UNCLASSIFIED_KICK = 999   # sentinel for a kick row that fits no rule (Q12)


def kick_points(fg, dist, xp) -> Column:
    """Made FG under 40 yards 3, under 50 4, else 5; missed/blocked FG -1;
    good XP 1; failed/blocked XP -1; anything else the sentinel 999.
    Branches fall through on NULL like ``case_when``."""
    fg, dist, xp = col_(fg), col_(dist), col_(xp)
    made = fg == "made"
    return (F.when(made & (dist < 40), 3)
            .when(made & (dist < 50), 4)
            .when(made, 5)
            .when(is_in(fg, FG_RESULTS_MISS), -1)
            .when(xp == "good", 1)
            .when(is_in(xp, XP_RESULTS_MISS), -1)
            .otherwise(UNCLASSIFIED_KICK))


def made_distance(fg, xp, dist) -> Column:
    """Distance of a made FG or good XP, else NULL (``ifelse`` with NA-cond -> NA)."""
    fg, xp = col_(fg), col_(xp)
    cond = (fg == "made") | (xp == "good")
    return F.when(cond, col_(dist)).when(~cond, F.lit(None))


def zone_masks(yardline, epa, yards_gained=None) -> dict[str, Column]:
    """Red zone (< 20), pink zone [20, 40), big play (>= 20), loss (<= -5)."""
    y, e = col_(yardline), col_(epa)
    out = {
        "redzone_epa": if_na(y < 20, e, F.lit(None).cast("double")),
        "pinkzone_epa": if_na((y < 40) & (y >= 20), e, F.lit(None).cast("double")),
    }
    if yards_gained is not None:
        g = col_(yards_gained)
        out["big_play_20"] = if_na(g >= 20, 1, 0)
        out["neg_play_5"] = if_na(g <= -5, 1, 0)
    return out


def play_bucket(rush, pass_) -> Column:
    """Rush / pass / other; NULL flags fall through to other."""
    return (F.when(col_(rush) == 1, "rush").when(col_(pass_) == 1, "pass").otherwise("other"))


def implied_totals(total, spread) -> tuple[Column, Column]:
    """(home, away) implied points from a total and a spread."""
    t, s = col_(total), col_(spread)
    return t / 2 + s / 2, t / 2 - s / 2


def by_role(team, home, away, home_value, away_value) -> Column:
    """Value by whether ``team`` is the home or the away side, else NULL."""
    t = col_(team)
    return F.when(t == col_(home), col_(home_value)).when(t == col_(away), col_(away_value))


def goal_to_go(yardline, ydstogo) -> Column:
    """Inside the 10, the distance to go is the distance to the goal line.
    NULL condition -> NULL (``ifelse``)."""
    y = col_(yardline)
    return if_na(y < 10, y, col_(ydstogo))
