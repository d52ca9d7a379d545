import numpy as np
from pyspark.sql import functions as F

from sidelines.operators.aggregates import hexbin, histogram, null_profile, quantiles, with_scalar


def test_quantiles_type7_with_hot_group(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=3000).round(3)           # one group holds most rows
    small = rng.normal(size=7).round(3)
    data = [("hot", float(v)) for v in hot] + [("s", float(v)) for v in small] + [("s", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, x double")
    q = {r["g"]: r for r in quantiles(df, ["g"], "x", {"p10": 0.1, "med": 0.5, "p75": 0.75}, buckets=16).collect()}
    for g, vals in (("hot", hot), ("s", small)):
        for name, p in (("p10", 0.1), ("med", 0.5), ("p75", 0.75)):
            assert abs(q[g][name] - np.quantile(vals, p)) < 1e-9   # numpy default = type 7
    assert "empty" not in q


def test_histogram_and_clip(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (9.99,), (10.0,), (11.0,), (-1.0,)], "x double")
    h = {r["bin"]: r["n"] for r in histogram(df, "x", 10, (0.0, 10.0)).collect()}
    assert h == {0: 2, 1: 1, 9: 2}          # 10.0 is in the last bin, 11 and -1 dropped


def test_hexbin_counts_all_points(spark):
    rng = np.random.default_rng(1)
    pts = [(float(a), float(b)) for a, b in rng.uniform(0, 10, size=(500, 2))]
    df = spark.createDataFrame(pts, "x double, y double")
    cells = hexbin(df, "x", "y", (1.0, 1.0)).collect()
    assert sum(r["n"] for r in cells) == 500
    for r in cells:                          # centres lie on one of the two lattices
        fx, fy = r["hex_x"] % 1, r["hex_y"] % 1
        assert (fx, fy) in ((0.0, 0.0), (0.5, 0.5))


def test_null_profile_and_scalar(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "a")], "a int, b string")
    assert null_profile(df).first().asDict() == {"a": 1, "b": 2}
    out = with_scalar(df, df.agg(F.max("a").alias("mx")))
    assert {r["mx"] for r in out.collect()} == {3}
