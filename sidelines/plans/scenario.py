"""Expected points and scenario grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.functions.nulls import col_
from sidelines.functions.text import label
from sidelines.operators.joins import scenario
from sidelines.operators.scan import Scan, segmented_scan

__all__ = ["SCORE_POINTS", "SCORE_OF_EVENT", "next_score", "empirical_ep", "expected_points", "scenario",
           "slice_grid", "tooltip", "fit_ep_model", "score_ep_model"]

# Points of each next-score outcome.
SCORE_POINTS = {"Touchdown": 7, "Field_Goal": 3, "Safety": 2, "No_Score": 0,
                "Opp_Safety": -2, "Opp_Field_Goal": -3, "Opp_Touchdown": -7}
# Adapter mapping: which event scores what.
SCORE_OF_EVENT = {"purchase": "Touchdown", "signup": "Field_Goal", "error": "Opp_Touchdown",
                  "click": "Opp_Field_Goal"}


def next_score(plays: DataFrame, keys: Sequence[str] = ("game_id", "posteam"), order: Sequence[str] = ("play_id",),
               score_col: str = "score_type", out: str = "next_score") -> DataFrame:
    """The first score at or after each play within its game half;
    ``No_Score`` when none follows.  ``order`` must be unique within ``keys``.

    A segmented scan from the group's end, so a group of any size is spread
    over many tasks.  All columns of ``plays`` travel: project it first."""
    found = segmented_scan(plays, keys, order, {out: Scan("last", score_col, reverse=True)})
    return found.withColumn(out, F.coalesce(out, F.lit("No_Score")))


def points_of(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SCORE_POINTS.items() for x in kv])
    return F.element_at(m, col_(c))


def empirical_ep(labelled: DataFrame, by: Sequence[str], label_col: str = "next_score") -> DataFrame:
    """I8 with an empirical model: P(outcome | state) from counts, then
    EP = sum(points x P).  One aggregation over the plays."""
    return labelled.groupBy(*by).agg((F.sum(points_of(label_col)) / F.count(F.lit(1))).alias("ep"),
                                     F.count(F.lit(1)).alias("n_plays"))


def expected_points(scored: DataFrame, prob_col: str = "probability", labels: Sequence[str] = (),
                    out: str = "ep") -> DataFrame:
    """I8 for a fitted classifier: sum over outcome classes of points x
    predicted probability (``labels`` in the model's class order)."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(prob_col)
    terms = [arr[i] * F.lit(float(SCORE_POINTS[lbl])) for i, lbl in enumerate(labels)]
    total = terms[0]
    for t_ in terms[1:]:
        total = total + t_
    return scored.withColumn(out, total)


def slice_grid(df: DataFrame, filters: Mapping[str, Sequence], factors: Mapping[str, tuple] = ()) -> DataFrame:
    """Keep grid rows whose columns take the listed values, then attach
    factor labels (``factors``: column -> (levels, labels))."""
    from sidelines.functions.factor import factor_label, factor_ordinal
    from sidelines.functions.nulls import is_in

    cond = F.lit(True)
    for c, vals in filters.items():
        cond = cond & is_in(c, vals)
    out = df.where(cond)
    for c, (levels, labels) in dict(factors).items():
        out = out.withColumns({f"{c}_label": factor_label(c, levels, labels), f"{c}_ord": factor_ordinal(c, levels)})
    return out


def tooltip(parts: Sequence[tuple[str, Column]], sep: str = "<br>") -> Column:
    """Hover text ``name: value`` joined by ``sep``."""
    pieces = []
    for i, (name, c) in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces += [F.lit(f"{name}: "), c]
    return label(*pieces)


def fit_ep_model(labelled: DataFrame, features: Sequence[str], label_col: str = "next_score",
                 max_iter: int = 50, reg: float = 0.0):
    """I8 re-aimed: multinomial logistic regression of the next-score class
    on game-state features (MLlib, distributed L-BFGS)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    idx = StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc")
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg)
    model = Pipeline(stages=[idx, va, lr]).fit(labelled)
    return model, list(model.stages[0].labels)


def score_ep_model(model, labels: Sequence[str], grid: DataFrame) -> DataFrame:
    """Score a scenario grid with the fitted model and add ``ep``."""
    from pyspark.ml import PipelineModel

    pm = PipelineModel(stages=model.stages[1:])
    return expected_points(pm.transform(grid), "probability", labels).drop("features", "rawPrediction")

