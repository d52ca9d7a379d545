"""Saved models score as before, also in another session."""
import os
import subprocess
import sys
import tempfile
import textwrap

import pytest
from pyspark.sql import functions as F

from sidelines.ml.gramcv import fit_linear
from sidelines.ml.models import fit_forest
from sidelines.ml.recipe import recipe
from sidelines.ml.stack import fit_stack, oof_predictions
from sidelines.ml.store import FittedStack, load_stack, save_stack, versions
from sidelines.ml.svr import fit_svr

FEATS = ["a", "b"]


def frame(spark):
    return spark.range(240).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.lit(1.0).alias("c"),
                                   ((F.col("id") % 7) * 2 + F.sin(F.col("id") % 11)).alias("y"), (F.col("id") % 4).cast("int").alias("fold"))


def fitted(spark):
    df = frame(spark)
    rm = recipe(df, [*FEATS, "c"], corr=None, lincomb=False, scale=True)
    work = rm.transform(df)
    members = {"line": lambda d: fit_linear(d, FEATS, "y", 0.01, 0.5), "svr": lambda d: fit_svr(d, FEATS, "y", iterations=10, landmarks=20),
               "forest": lambda d: fit_forest(d, FEATS, "y", trees=4, min_n=2)}
    oof = oof_predictions(work, "fold", members, ["id"], 4).join(df.select("id", "y"), "id")
    return FittedStack(rm, {n: f(work) for n, f in members.items()}, fit_stack(oof, list(members), "y", [0.01, 0.1]))


def scores(spark, stack):
    return sorted((r["id"], r["prediction"], r["svr"]) for r in stack.transform(frame(spark)).collect())


def test_same_scores_after_reload_and_in_another_session(spark):
    path = tempfile.mkdtemp(prefix="sidelines-store-")
    one = fitted(spark)
    before = scores(spark, one)
    assert versions(spark, f"{path}/s") == [] and save_stack(spark, f"{path}/s", one) == 1
    assert scores(spark, load_stack(spark, f"{path}/s")) == before
    two = FittedStack(None, {"line": fit_linear(frame(spark), FEATS, "y")}, None)
    assert save_stack(spark, f"{path}/s", two) == 2 and versions(spark, f"{path}/s") == [1, 2]
    assert list(load_stack(spark, f"{path}/s").members) == ["line"] and scores(spark, load_stack(spark, f"{path}/s", 1)) == before
    code = textwrap.dedent(f"""
        import sys
        from sidelines import get_spark
        from tests.test_store import load_stack, scores
        spark = get_spark(master="local[2]", shuffle_partitions=2)
        print("SCORES", scores(spark, load_stack(spark, {path + '/s'!r}, 1)))""")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK")} | {"PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=200)
    assert f"SCORES {before}" in run.stdout, run.stderr[-2000:]


def test_unknown_versions_and_members(spark):
    path = tempfile.mkdtemp(prefix="sidelines-store-")
    with pytest.raises(ValueError):
        load_stack(spark, f"{path}/none")
    with pytest.raises(TypeError):
        save_stack(spark, f"{path}/bad", FittedStack(None, {"x": object()}, None))
    assert versions(spark, f"{path}/bad") == []
