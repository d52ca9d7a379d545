from pyspark.sql import functions as F

from sidelines.operators.joins import apply_patches, densify, enrich, grid, override, scenario, with_fallback_row
from sidelines.operators.reshape import append, dummies, pivot_longer, pivot_wider, separate


def test_enrich_null_safe_and_renamed(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "key string, v int")
    plain = {r["id"]: r["v"] for r in enrich(a, b, {"k": "key"}).collect()}
    safe = {r["id"]: r["v"] for r in enrich(a, b, {"k": "key"}, null_safe=True).collect()}
    assert plain == {1: None, 2: 20} and safe == {1: 10, 2: 20}


def test_densify_keeps_spine(spark):
    spine = spark.createDataFrame([("g1",), ("g2",)], "g string")
    facts = spark.createDataFrame([("g1", 3)], "g string, n int")
    assert sorted(tuple(r) for r in densify(facts, spine, ["g"], ["n"]).collect()) == [("g1", 3), ("g2", 0)]


def test_override_and_patches(spark):
    df = spark.createDataFrame([("a", None, 2021), ("b", None, 2020), ("c", "dome", 2021)],
                               "game string, roof string, season int")
    patch = spark.createDataFrame([("a", "open"), ("b", "closed"), ("c", "closed")], "game string, roof_update string")
    o = {r["game"]: r["roof"] for r in override(df, patch, "game", "roof", "roof_update",
                                               when=F.col("season") == 2021).collect()}
    assert o == {"a": "open", "b": None, "c": "dome"}
    p = spark.createDataFrame([("a", "roof", "x", 1), ("a", "roof", "y", 2), ("b", "season", "1999", 3)],
                              "game string, column string, value string, patch_no int")
    out = {r["game"]: (r["roof"], r["season"]) for r in
           apply_patches(df, p, "game", {"roof": "string", "season": "int"}).collect()}
    assert out == {"a": ("y", 2021), "b": (None, 1999), "c": ("dome", 2021)}


def test_fallback_row(spark):
    df = spark.createDataFrame([("k1",), ("k9",)], "k string")
    dim = spark.createDataFrame([("k1", 0.9), ("Other", 0.84)], "k string, pct double")
    out = {r["k"]: r["pct"] for r in with_fallback_row(df, dim, "k", "Other", ["pct"]).collect()}
    assert out == {"k1": 0.9, "k9": 0.84}


def test_grid_order_and_scenario(spark):
    g = grid(spark, {"a": [3, 2], "b": ["x", "y", "z"]}).orderBy("grid_index").collect()
    assert [(r["a"], r["b"]) for r in g] == [(3, "x"), (3, "y"), (3, "z"), (2, "x"), (2, "y"), (2, "z")]
    s = scenario(spark, {"season": 2019, "a": 0}, {"a": [1, 2]})
    assert s.count() == 2 and set(s.columns) == {"season", "a", "grid_index"}


def test_reshape(spark):
    df = spark.createDataFrame([("m1", "train", 1.0, 2.0), ("m1", "test", 3.0, 4.0)], "m string, s string, r double, a double")
    w = pivot_wider(df, ["m"], "s", ["train", "test"], "r", prefix="rmse_").first()
    assert (w["rmse_train"], w["rmse_test"]) == (1.0, 3.0)
    w2 = pivot_wider(df, ["m"], "s", ["train", "test"], ["r", "a"]).first()
    assert w2["a_test"] == 4.0
    long = pivot_longer(df, ["r", "a"], "name", "value")
    assert long.count() == 4
    sp = separate(spark.createDataFrame([("A#1#x",), ("B",)], "c string"), "c", ["p", "q"], "#").collect()
    assert [(r["p"], r["q"]) for r in sp] == [("A", "1"), ("B", None)]


def test_dummies_drop_mode_and_append(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "r string")
    d = dummies(df, ["r"])
    assert set(d.columns) == {"r", "r_b", "r_c"}
    assert [r["r_b"] for r in d.collect()] == [0, 0, 1, 0, None]
    u = append(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("s",)], "y string"))
    assert sorted(u.columns) == ["x", "y"] and u.count() == 2
