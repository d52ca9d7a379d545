"""Sparse levels, exact permutation, preamble files, impact draws."""
import hashlib
import re

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidelines.ml.importance import permutation_importance, permute_column, permuted
from sidelines.operators.aggregates import with_scalar
from sidelines.operators.reshape import level_dictionary, sparse_levels, sparse_vector
from sidelines.plans.impact import bootstrap_draws
from sidelines.session import checkpoint_dir
from sidelines.sources.io import read_csv_skip


def test_levels_positions_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, "c", "y"), (4, None, "x"), (5, "c", "x")], "id int, p string, q string")
    assert {r["level"]: (r["n"], r["i"]) for r in level_dictionary(df, "p", "i").collect()} == {"c": (2, 0), "a": (1, 1), "b": (1, 2)}
    out, size = sparse_levels(df, ["p", "q"])
    assert size == 3 and {r["id"]: r["hot"] for r in out.collect()} == {1: [1], 2: [0, 2], 3: [2], 4: None, 5: []}
    full, size = sparse_levels(df, ["p"], drop=None)
    assert size == 3 and {r["id"]: r["hot"] for r in full.collect()} == {1: [2], 2: [1], 3: [0], 4: None, 5: [0]}
    v = {r["id"]: r["features"] for r in sparse_vector(out, 3).collect()}
    assert v[4] is None and v[2].toArray().tolist() == [1, 0, 1] and v[5].toArray().tolist() == [0, 0, 0]


def test_a_hundred_thousand_levels(spark):
    n = 100_000
    df = spark.range(n + n // 2).select("id", (F.col("id") % n).alias("level"), (F.col("id") % 7).cast("double").alias("y"))
    out, size = sparse_levels(df, ["level"])
    assert size == n - 1
    # levels below n / 2 stand twice: the mode is level 0, then 1 to n/2 - 1, then the rest
    bad = F.coalesce(F.get("hot", F.lit(0)), F.lit(-1)) != F.col("level") - 1
    assert out.agg(F.count("*"), F.count_if(bad)).first() == (n + n // 2, 0)
    few, width = sparse_levels(df.withColumn("level", F.col("level") % 7), ["level"])
    fit = LinearRegression(labelCol="y").fit(sparse_vector(few, width))
    assert fit.coefficients.size == 6 and fit.summary.r2 > 0


def test_permutation_is_exact_and_the_same_at_any_layout(spark):
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.lit("x").alias("extra"))
    one = permute_column(df.repartition(3), "v", ["k"], 5)
    two = permute_column(df.repartition(40), "v", ["k"], 5)
    assert one.columns == df.columns and one.exceptAll(two).count() == 0
    assert one.agg(F.count_distinct("v"), F.min("v"), F.max("v")).first() == (n, 0, 3 * (n - 1))
    assert one.where(F.col("v") == F.col("k") * 3).count() < 20
    small = {r["k"]: r["v_permuted"] for r in permuted(df.where("k < 50"), ["v"], ["k"], 5).collect()}
    order = sorted(range(50), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    assert small == {k: 3 * order[k] for k in range(50)}


def test_importance_finds_the_used_predictor(spark):
    df = spark.range(2000).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 2)
    imp = {r["variable"]: r["importance"] for r in permutation_importance(lambda d: d.withColumn("prediction", F.col("a") * 2), df, ["a", "b"], "y", ["id"]).collect()}
    assert imp["a"] > 5 and imp["b"] == 0


def test_preamble_file_over_several_tasks(spark):
    path = f"{checkpoint_dir(spark)}/preamble-split"
    text = "Category: all\n\nday,n\n" + "\n".join(f"{i},{i * 2}" for i in range(200_000))
    spark.createDataFrame([(text,), ("note\nmore\nday,n\n7,7\n\n8,8",)], "value string").repartition(2).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("day", T.LongType()), T.StructField("n", T.LongType())])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = read_csv_skip(spark, path, 2, schema)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 5
        assert df.agg(F.count("*"), F.sum("day"), F.count_if(F.col("n").isNull())).first() == (200_002, sum(range(200_000)) + 15, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert read_csv_skip(spark, path, 3, schema, header=False).count() == 200_002
    assert read_csv_skip(spark, path, 500_000, schema).count() == 0


def test_draws_do_not_repeat(spark):
    win = spark.range(1, 331).select(F.lit("s").alias("k"), F.col("id").alias("idx"), F.col("id").cast("double").alias("y_actual"),
                                     F.when(F.col("id") <= 300, "pre").otherwise("post").alias("phase"))
    d = bootstrap_draws(win, ["k"], 300, 1000)
    assert d.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("idx", "y_hat"))).alias("a")).select("a").distinct().count() == 1000
    assert d.count() == 30_000 and d.agg(F.count_distinct("y_hat")).first()[0] == 300


def test_scalars_come_from_one_subquery(spark):
    df = spark.range(10)
    out = with_scalar(df, df.agg(F.max("id").alias("m"), F.min("id").alias("n")))
    assert out.where("m = 9 and n = 0").count() == 10
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedSubquery" in plan or len(set(re.findall(r"subquery#(\d+)", plan))) == 1
