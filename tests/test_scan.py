"""Segmented scans against plain windows, and on one group over many tasks."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sidelines.operators.scan import MAX, Monoid, Scan, scan_fill, scan_lagged, segmented_scan
from sidelines.operators.windows import deal_out, fill, lagged_cum

FNS = ["sum", "count", "max", "min", "mean"]


def rows(spark, n=3000):
    v = F.when(F.col("id") % 5 != 2, (F.xxhash64("id") % 1000).cast("double"))
    return spark.range(n).select("id", F.when(F.col("id") % 4 != 3, F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("g"),
                                 (F.xxhash64("id", F.lit(3)) % 50).alias("o"), v.alias("v"))


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("na", ["skip", "poison"])
def test_lagged_scans_equal_windows(spark, na):
    df = rows(spark)
    out = scan_lagged(df, ["g"], ["o", "id"], **{f: ("v", f, na) for f in FNS})
    want = df.select("*", *[lagged_cum("v", f, ["g"], ["o", "id"], na).alias(f) for f in FNS])
    r = [F.round(f, 6).alias(f) for f in FNS]
    assert values(out.select("id", *r)) == values(want.select("id", *r))


def test_inclusive_and_reverse_scans_equal_windows(spark):
    df = rows(spark)
    out = segmented_scan(df, ["g"], ["o", "id"], {"up": Scan("sum", "v"), "down": Scan("sum", "v", reverse=True), "after": Scan("max", "v", True, True),
                                                  "n": Scan("count", "v")})
    w = Window.partitionBy("g").orderBy("o", "id")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("id", F.sum("v").over(before), F.sum("v").over(after), F.max("v").over(w.rowsBetween(1, Window.unboundedFollowing)),
                     F.count("v").over(before))
    assert values(out.select("id", "up", "down", "after", "n")) == values(want)


@pytest.mark.parametrize("direction", ["down", "up", "downup"])
def test_fills_equal_windows(spark, direction):
    df = rows(spark)
    assert values(scan_fill(df, ["g"], ["o", "id"], ["v"], direction)) == values(fill(df, ["g"], ["o", "id"], ["v"], direction))


def test_own_monoid_and_no_keys(spark):
    """Longest text so far, the later one at a tie: a monoid over structs."""
    df = spark.createDataFrame([(i, "x" * (i * 7 % 5)) for i in range(40)], "id long, t string")
    longest = Monoid(MAX.local, MAX.partial, MAX.merge, MAX.combine)
    out = segmented_scan(df, [], ["id"], {"m": Scan(longest, F.struct(F.length("t"), F.col("id")))})
    got = {r["id"]: r["m"][1] for r in out.collect()}
    best, want = (-1, -1), {}
    for i in range(40):
        best = max(best, (i * 7 % 5, i))
        want[i] = best[1]
    assert got == want


def test_empty_single_rows_and_bad_direction(spark):
    df = rows(spark)
    assert scan_lagged(df.limit(0), ["g"], ["id"], s=("v", "sum")).count() == 0
    one = scan_lagged(df.limit(1), ["g"], ["id"], s=("v", "sum"), n=("v", "count")).first()
    assert one["s"] is None and one["n"] is None
    with pytest.raises(ValueError):
        scan_fill(df, ["g"], ["id"], ["v"], "sideways")


def test_one_group_over_many_tasks(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        n = 1_000_000
        df = spark.range(n).select("id", F.lit("hot").alias("g"), F.lit(1).alias("v"), F.when(F.col("id") % 99_991 == 0, F.col("id")).alias("k"))
        assert deal_out(df, ["g"], ["id"]).select("_pid").distinct().count() >= 8
        out = segmented_scan(df, ["g"], ["id"], {"s": Scan("sum", "v", lagged=True), "k2": Scan("last", "k")})
        bad = (F.coalesce("s", F.lit(0)) != F.col("id")) | (F.col("k2") != F.col("id") - F.col("id") % 99_991)
        assert out.agg(F.count("*"), F.count_if(bad)).first() == (n, 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
