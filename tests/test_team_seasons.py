from sidelines.plans.adapter import plays_from_events
from sidelines.plans.cube import play_cube
from sidelines.plans.final import team_seasons
from sidelines.session import cut_lineage
from sidelines.sources.io import table


def test_a_teams_rows_are_dealt_once(spark):
    """Totals, weeks, windows and fills of a side share one exchange; each of them had its own."""
    cube = cut_lineage(play_cube(plays_from_events(table(spark, "/root/testdata/sf0.001", "events"))))
    out = team_seasons(cube, True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("posteam" in x or "defteam" in x)]
    assert len(dealt) <= 4, dealt
    assert out.where("team IS NULL").count() == 0 and out.count() == out.select("team", "season").distinct().count()
