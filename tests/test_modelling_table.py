"""The modelling table's team sides from two joins, and its imputation on reading."""
import numpy as np
from pyspark.sql import functions as F

from sidelines.ml.gram import column_means
from sidelines.plans import final, q_ml
from sidelines.plans.cube import play_cube
from sidelines.plans.q_plays import plays
from sidelines.plans.team import DEF_MA_COLS, OFF_MA_COLS, defense_mvavg, offense_mvavg, zone_defense, zone_offense

SF = "/root/testdata/sf0.001"


def test_team_rates_equal_one_join_for_each_side(spark, tmp_path):
    cube = play_cube(plays(spark, SF))
    cube.write.parquet(str(tmp_path / "cube"))
    cube = spark.read.parquet(str(tmp_path / "cube"))
    rows = cube.select("season", "game_id", "posteam", "defteam", "week").distinct()
    odd = spark.createDataFrame([("x1", None, "T1", 3), ("x2", "T1", None, 3), ("x3", "T1", "T0", None), ("x4", "T1", "T0", 99), ("x5", "none", "none", 3)],
                                "game_id string, posteam string, defteam string, week int")
    rows = rows.unionByName(odd.crossJoin(rows.agg(F.min("season").alias("season"))).select(rows.columns))
    got = final.with_team_rates(rows, final.team_seasons(cube, True))
    zo, zd, om, dm = zone_offense(cube), zone_defense(cube), offense_mvavg(cube, True), defense_mvavg(cube, True)
    want = rows

    def side(t, own, team, weekly, names):
        nonlocal want
        keys = [team, "season", *(["week"] if weekly else [])]
        t = t.select(F.col(own).alias(team), *keys[1:], *[F.col(a).alias(b) for a, b in names.items()])
        want = want.join(t, keys, "left")

    side(zo, "posteam", "posteam", False, {c: c for c in final.ZONE_OFF})
    side(zd, "defteam", "defteam", False, {c: c for c in final.ZONE_DEF})
    side(om, "posteam", "posteam", True, {c: c for c in OFF_MA_COLS})
    side(dm, "defteam", "defteam", True, {c: c for c in DEF_MA_COLS})
    side(zo, "posteam", "defteam", False, final.OPPONENT_OFF)
    side(zd, "defteam", "posteam", False, final.OPPONENT_DEF)
    side(om, "posteam", "defteam", True, {f"{a}_ma": f"{b}_ma" for a, b in final.OPPONENT_OFF.items()})
    side(dm, "defteam", "posteam", True, {f"{a}_ma": f"{b}_ma" for a, b in final.OPPONENT_DEF.items()})
    assert sorted(got.columns) == sorted(want.columns)
    keep = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    a, b = ([tuple(r) for r in x.select(keep).collect()] for x in (got, want))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) > 100
    joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins == 2


def test_modelling_rows_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(q_ml, "cut_lineage", lambda df: written.append(df) or df.cache())
    frame = q_ml.model_frame(spark, SF)
    assert len(written) == 1
    feats = sorted({c for v in q_ml.FEATURE_SETS.values() for c in v})
    assert frame.where(" OR ".join(f"{c} IS NULL" for c in feats)).count() == 0 and frame.count() == written[0].count()
    written[0].unpersist()


def test_column_means(spark):
    df = spark.createDataFrame([(1.0, None, 2, float("nan")), (None, None, 3, 1.0), (4.0, None, None, 2.0)], "a double, b double, c int, d double")
    m = column_means(df, ["a", "b", "c", "d"])
    assert (m["a"], m["b"], m["c"]) == (2.5, None, 2.5) and np.isnan(m["d"])
    assert column_means(df.limit(0), ["a"]) == {"a": None}
