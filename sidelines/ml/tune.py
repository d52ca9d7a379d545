"""Hyper-parameter search over folds.

Candidates come from a Latin hypercube over the search space (the source's
Bayesian proposal engine is re-aimed, see README); every candidate is
cross-validated on a fold column with ``CrossValidator`` running
``parallelism`` fits at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame

__all__ = ["latin_hypercube", "tune"]


def latin_hypercube(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``space``: name -> (lo, hi, kind) with kind in lin|log|int."""
    rng = np.random.default_rng(seed)
    cols = {}
    for name, (lo, hi, kind) in space.items():
        u = (rng.permutation(n) + rng.uniform(size=n)) / n
        if kind == "log":
            v = np.exp(np.log(lo) + u * (np.log(hi) - np.log(lo)))
        else:
            v = lo + u * (hi - lo)
        cols[name] = [int(round(x)) for x in v] if kind == "int" else [float(x) for x in v]
    return [{k: cols[k][i] for k in cols} for i in range(n)]


def tune(estimator, space: Mapping[str, tuple], df: DataFrame, features: Sequence[str], label: str,
         fold_col: str = "fold", n: int = 10, seed: int = 42, parallelism: int = 4, metric: str = "rmse"):
    """Returns (best PipelineModel, results DataFrame(config, params..., mean, std_err))."""
    estimator.setFeaturesCol("features").setLabelCol(label)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                            estimator])
    cands = latin_hypercube(space, n, seed)
    maps = [{estimator.getParam(k): v for k, v in c.items()} for c in cands]
    k = df.select(fold_col).distinct().count()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                        evaluator=RegressionEvaluator(labelCol=label, metricName=metric),
                        foldCol=fold_col, numFolds=k, parallelism=parallelism, seed=seed)
    model = cv.fit(df)
    std = list(model.stdMetrics) if getattr(model, "stdMetrics", None) else [float("nan")] * len(cands)
    rows = [(i, *[float(c[p]) for p in space], float(m), float(float(s) / np.sqrt(k)))
            for i, (c, m, s) in enumerate(zip(cands, model.avgMetrics, std))]
    schema = "config int, " + ", ".join(f"{p} double" for p in space) + ", mean double, std_err double"
    return model.bestModel, df.sparkSession.createDataFrame(rows, schema)
