from pyspark.sql import functions as F

from sidelines.session import _SHIPPED, checkpoint_dir, cut_lineage, ship_package


def test_cut_lineage_writes_to_checkpoint_dir(spark):
    df = spark.range(0, 100).withColumn("x", F.col("id") * 2)
    out = cut_lineage(df)
    base = checkpoint_dir(spark)
    assert all(base.rstrip("/").split("/")[-1] in f for f in out.inputFiles())
    assert sorted(r["x"] for r in out.collect()) == [2 * i for i in range(100)]


def test_ship_package_once_per_application(spark):
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.applicationId in _SHIPPED
