from pyspark.sql import types as T

from sidelines.sources.io import baseline, load_overrides, read_csv_skip, read_indexed_csv, read_many, save_table


def test_csv_readers(spark, tmp_path):
    p = tmp_path / "series.csv"
    p.write_text("Category: All categories\n\nWeek,WNBA tickets: (United States)\n2023-01-01,12\n2023-01-08,15\n")
    s = T.StructType([T.StructField("Week", T.DateType()), T.StructField("trend", T.DoubleType())])
    df = read_csv_skip(spark, str(p), 2, s)
    assert [tuple(r) for r in df.orderBy("Week").collect()][0][1] == 12.0 and df.count() == 2

    q = tmp_path / "roof.csv"
    q.write_text("game_id,roof_update\n2021_01_A_B,open\n")
    assert load_overrides(spark, str(q)).first()["roof_update"] == "open"

    r = tmp_path / "idx.csv"
    r.write_text(",kicker_name,pct\n1,A.Kick,0.8\n2,NA,0.9\n")
    ix = read_indexed_csv(spark, str(r), T.StructType([T.StructField("kicker_name", T.StringType()),
                                                       T.StructField("pct", T.DoubleType())]))
    assert ix.columns == ["kicker_name", "pct"] and ix.where("kicker_name is null").count() == 1

    d = tmp_path / "proj"
    d.mkdir()
    for wk in (3, 4):
        (d / f"week{wk}.csv").write_text("Player,FPTS\nJ Doe,7.5\n")
    many = read_many(spark, str(d / "*.csv"), T.StructType([T.StructField("Player", T.StringType()),
                                                            T.StructField("FPTS", T.DoubleType())]), "src")
    assert many.count() == 2 and all("week" in r["src"] for r in many.collect())


def test_baseline_and_sink(spark, tmp_path):
    b = baseline(spark, season=2019, posteam="SEA")
    out = str(tmp_path / "out")
    save_table(b, out)
    assert spark.read.parquet(out).first()["posteam"] == "SEA"


def test_load_ratings(spark, tmp_path):
    from sidelines.sources.io import load_ratings
    for season, team in ((2020, "JAC"), (2021, "KC")):
        (tmp_path / f"r{season}.csv").write_text(f"rank,team,total dvoa\n1,{team},0.25\n")
    schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("team", T.StringType()),
                           T.StructField("total dvoa", T.DoubleType())])
    df = load_ratings(spark, {2020: str(tmp_path / "r2020.csv"), 2021: str(tmp_path / "r2021.csv")}, schema,
                      drop=["rank"], rename={"Total Dvoa": "Total.dvoa"}, fix={"JAC": "JAX"})
    rows = sorted((r["season"], r["Team"], r["Total.dvoa"]) for r in df.collect())
    assert rows == [(2020, "JAX", 0.25), (2021, "KC", 0.25)]
