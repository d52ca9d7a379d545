from pyspark.sql import Window
from pyspark.sql import functions as F

from sidelines.operators.filters import keep_groups
from sidelines.operators.ordering import ranked_board
from sidelines.operators.windows import (fallback_chain, fill, global_row_number, group_id, lagged_cum,
                                         last_per_group, season_to_date_ratio, suppress_small, with_totals)

from sidelines.plans.scenario import next_score

GAMES = [("k", 1, "g1", 2, 3, 40.0), ("k", 1, "g2", 1, 1, None), ("k", 1, "g3", 0, 0, 55.0), ("k", 1, "g4", 3, 3, 30.0),
         ("k", 2, "g5", 1, 2, 20.0)]
SCHEMA = "kicker string, season int, game string, made int, att int, dist double"


def test_lagged_cumulative(spark):
    df = spark.createDataFrame(GAMES, SCHEMA)
    K, O = ["kicker", "season"], ["game"]
    out = df.select("game", season_to_date_ratio("made", "att", K, O).alias("pct"),
                    lagged_cum("dist", "max", K, O).alias("mx"), lagged_cum("dist", "max", K, O, na="poison").alias("mxp"),
                    lagged_cum("dist", "count", K, O).alias("n"), lagged_cum("made", "mean", K, O).alias("m")) \
        .orderBy("game").collect()
    assert [r["pct"] for r in out] == [None, 2 / 3, 3 / 4, 3 / 4, None]
    assert [r["mx"] for r in out] == [None, 40.0, 40.0, 55.0, None]
    assert [r["mxp"] for r in out] == [None, 40.0, None, None, None]     # NULL poisons like cummax
    assert [r["n"] for r in out] == [None, 1, 1, 2, None]                # first row NULL, not 0
    assert [r["m"] for r in out] == [None, 2.0, 1.5, 1.0, None]


def test_no_leakage_property(spark):
    """Changing a later game never changes an earlier game's features."""
    K, O = ["kicker", "season"], ["game"]
    a = spark.createDataFrame(GAMES, SCHEMA)
    b = spark.createDataFrame([g if g[2] != "g4" else ("k", 1, "g4", 0, 9, 99.0) for g in GAMES], SCHEMA)
    fa = a.select("game", season_to_date_ratio("made", "att", K, O).alias("p")).orderBy("game").collect()
    fb = b.select("game", season_to_date_ratio("made", "att", K, O).alias("p")).orderBy("game").collect()
    assert fa == fb          # g4's own feature only looks at g1..g3


def test_fill_down_and_downup(spark):
    df = spark.createDataFrame([("t", 1, None), ("t", 2, "A"), ("t", 3, None), ("t", 4, "B"), ("u", 1, None)],
                               "team string, g int, k string")
    d = fill(df, ["team"], ["g"], ["k"], "down").orderBy("team", "g").collect()
    du = fill(df, ["team"], ["g"], ["k"], "downup").orderBy("team", "g").collect()
    assert [r["k"] for r in d] == [None, "A", "A", "B", None]
    assert [r["k"] for r in du] == ["A", "A", "A", "B", None]


def test_fallback_chain_and_suppress(spark):
    df = spark.createDataFrame([(None, 0.5, 0.7, 0.8), (5, 0.5, None, 0.8), (6, 0.5, 0.7, 0.8), (2, 0.5, None, None)],
                               "n int, own double, last double, league double")
    out = [r[0] for r in df.select(fallback_chain("own", "n", 6, "last", "league")).collect()]
    assert out == [0.7, 0.8, 0.5, None]
    sup = [r[0] for r in df.select(suppress_small("own", "n", 6)).collect()]
    assert sup == [None, None, 0.5, None]


def test_totals_last_row_group_id(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0), (None, 1, 1.0)], "g string, o int, v double")
    t = {(r["g"], r["o"]): r["tot"] for r in with_totals(df.where("g is not null"), ["g"], tot=F.sum("v")).collect()}
    assert t[("a", 1)] == 30.0 and t[("b", 1)] == 5.0
    last = {r["g"]: (r["v"], r["n"]) for r in last_per_group(df.where("g is not null"), ["g"], ["o"]).collect()}
    assert last == {"a": (20.0, 2), "b": (5.0, 1)}
    gid = sorted((r["g"], r["group_id"]) for r in group_id(df.where("g is not null"), ["g"]).collect())
    assert gid == [("a", 1), ("a", 1), ("b", 2)]


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 1000).alias("v"))
    got = {(r["id"]): r["rn"] for r in global_row_number(df, ["v", "id"], "rn", keys=["k"]).collect()}
    from pyspark.sql import Window
    exp = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("k").orderBy("v", "id"))).collect()}
    assert got == exp


def test_numbering_keeps_every_row(spark):
    """Wide rows, small advisory partitions: n rows, n ranks, in order."""
    n = 1_000_000
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(n).select(F.col("id"), (F.xxhash64("id") % 1000).alias("score"), (F.col("id") % 3).alias("board"),
                                   F.repeat(F.col("id").cast("string"), 5).alias("extra"))
        for keys in ([], ["board"]):
            out = global_row_number(df, [F.col("score").desc_nulls_last(), "id"], "rk", keys=keys)
            wrong = F.lag(F.struct(-F.col("score"), "id")).over(Window.partitionBy("board").orderBy("rk")) > F.struct(-F.col("score"), "id")
            rows, ranks, top = out.agg(F.count("*"), F.count_distinct("rk", *keys), F.max("rk")).first()
            assert rows == n and ranks == n and top == (n if not keys else -(-n // 3))
            assert out.select(wrong.alias("w")).where("w").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([("a", 1, 5.0), (None, 2, None), (None, 3, 7.0), ("a", 4, None)], "g string, o int, v double")
    rn = {r["o"]: r["rn"] for r in global_row_number(df, ["o"], "rn", keys=["g"]).collect()}
    assert rn == {1: 1, 4: 2, 2: 1, 3: 2}
    assert {r["o"]: r["group_id"] for r in group_id(df, ["g"]).collect()} == {1: 1, 4: 1, 2: 2, 3: 2}      # NULLs last
    assert {r["o"]: r["n"] for r in with_totals(df, ["g"], n=F.count("*")).collect()} == {1: 2, 2: 2, 3: 2, 4: 2}
    board = ranked_board(df, "v", ["g"], tiebreak=["o"])
    assert {r["o"]: r["rank"] for r in board.collect()} == {1: 1, 4: 2, 3: 1, 2: 2}
    assert sorted(r["o"] for r in keep_groups(df, ["g"], F.count("*") > 1).collect()) == [1, 2, 3, 4]


def test_scans_are_linear_in_a_group(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("game_id"), F.lit("t").alias("posteam"), F.col("id").alias("play_id"),
                                       F.when(F.col("id") % 70_000 == 69_999, F.lit("Field_Goal")).alias("score_type"))
    out = next_score(df)
    assert {r[0]: r[1] for r in out.groupBy("next_score").count().collect()} == {"Field_Goal": 980_000, "No_Score": 20_000}
    up = fill(df.limit(200_000), ["game_id"], ["play_id"], ["score_type"], "up")
    assert up.where("score_type is null").count() == up.where("play_id >= 140000").count()
