"""Fitted models with their recipe, written, versioned and read again.

A store is a folder on any file system Spark writes to.  Every save is a new
version: the models' files first, then one row in the store's manifest, so a
version is seen when it is whole or not at all.  Numbers are kept exactly (as
their shortest text that reads back to the same double); MLlib models keep their own format.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelines.ml.gramcv import LinearFit
from sidelines.ml.recipe import RecipeModel
from sidelines.ml.stack import StackModel
from sidelines.ml.svr import SvrModel

__all__ = ["FittedStack", "save_stack", "load_stack", "versions"]

_PLAIN = {c.__name__: c for c in (LinearFit, SvrModel, RecipeModel, StackModel)}


@dataclass
class FittedStack:
    """A recipe, members by name and the blend of their predictions (without a blend, one member's)."""
    recipe: RecipeModel | None
    members: Mapping[str, object]
    blend: StackModel | None

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the members' predictions under their names and the blend as ``out``; one pass, no join."""
        own = df.columns
        work = self.recipe.transform(df) if self.recipe else df
        for name, model in self.members.items():
            work = model.transform(work).withColumnRenamed("prediction", name).drop("features", "rawPrediction")
        work = self.blend.transform(work, out) if self.blend else work.withColumn(out, F.col(next(iter(self.members))))
        return work.select(*[c for c in own if c in work.columns], *self.members, out)


def _text(model) -> str:
    def plain(v):
        return {"array": v.tolist()} if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else list(v) if isinstance(v, tuple) else v
    return json.dumps({"class": type(model).__name__, "fields": {k: plain(v) for k, v in asdict(model).items()}})


def _model(text: str):
    d = json.loads(text)
    cls = _PLAIN[d["class"]]
    kinds = {f.name: str(f.type) for f in fields(cls)}
    back = {k: np.array(v["array"]) if isinstance(v, dict) and set(v) == {"array"} else tuple(v) if kinds[k].startswith("tuple") else v
            for k, v in d["fields"].items()}
    return cls(**back)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a store, rising; none if it does not exist."""
    try:
        return sorted(r[0] for r in spark.read.parquet(f"{path}/manifest").select("version").distinct().collect())
    except AnalysisException:
        return []


def save_stack(spark: SparkSession, path: str, fitted: FittedStack) -> int:
    """Write ``fitted`` as the store's next version; returns the version."""
    version = (versions(spark, path) or [0])[-1] + 1
    members = {}
    for name, model in fitted.members.items():
        if isinstance(model, PipelineModel):
            model.write().overwrite().save(f"{path}/models/{version}/{name}")
            members[name] = None
        elif type(model).__name__ in _PLAIN:
            members[name] = _text(model)
        else:
            raise TypeError(f"member {name}: a {type(model).__name__} cannot be stored")
    manifest = json.dumps({"recipe": _text(fitted.recipe) if fitted.recipe else None, "members": members,
                           "blend": _text(fitted.blend) if fitted.blend else None})
    spark.createDataFrame([(version, manifest)], "version int, manifest string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load_stack(spark: SparkSession, path: str, version: int | None = None) -> FittedStack:
    """The latest version of a store, or the one asked for."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {version if version is not None else ''}".rstrip())
    version = known[-1] if version is None else version
    d = json.loads(spark.read.parquet(f"{path}/manifest").filter(F.col("version") == version).first()["manifest"])
    members = {name: PipelineModel.load(f"{path}/models/{version}/{name}") if text is None else _model(text) for name, text in d["members"].items()}
    return FittedStack(_model(d["recipe"]) if d["recipe"] else None, members, _model(d["blend"]) if d["blend"] else None)
