"""The five objectives trained together: a registry of what each fits, its held-out metrics, and batch suggestions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from worklens import columns as C
from worklens.operators import encode, metrics, models, neighbors
from worklens.storage import stage

NEIGHBOURS = 5


@dataclass(frozen=True)
class Fit:
    """How an objective is trained: a name to show and ``make(split)`` for an estimator; no ``make`` for nearest neighbours."""

    algorithm: str
    make: Callable[[models.Split], object] | None = None
    balanced: bool = False
    # whether the estimator reads its rows about once
    one_pass: bool = False


FAST: Mapping[str, Fit] = {
    "sprint": Fit("Decision Tree", lambda s: models.tree(6), balanced=True),
    "workload": Fit("Naive Bayes", lambda s: models.gaussian_nb(), one_pass=True),
    "ttr": Fit("Ridge Regression", lambda s: models.ridge(s.n_train, models.label_deviation(s.train)), one_pass=True),
    "burnout": Fit("Decision Tree", lambda s: models.tree(5), balanced=True),
    "alloc": Fit("KNN"),
}

#: The same objectives by methods with a closed form.
CLOSED: Mapping[str, Fit] = FAST | {name: Fit("Naive Bayes", lambda s: models.gaussian_nb(), one_pass=True) for name in ("sprint", "burnout")}


def coded(df: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``df`` with the codes of its texts in the dictionaries of ``history`` (by default its own)."""
    return encode.label_encode(df, {"Summary": "Summary_enc", "Labels": "Labels_enc"}, fit_on=history)


def suggest_assignee(rows: DataFrame, history: DataFrame) -> DataFrame:
    """(row_id, predicted): the distance-weighted vote of the five nearest items of ``history``; a text it lacks gets code 0."""
    known, asked = coded(history), coded(rows, history)
    keep = ("row_id", "Assignee_Resource")
    at = encode.standardize(asked, C.ALLOC, ("row_id",), fit_on=known)
    matches = neighbors.knn_join(at, encode.standardize(known, C.ALLOC, keep), C.ALLOC, NEIGHBOURS, payload="Assignee_Resource")
    return neighbors.knn_vote(matches).withColumnRenamed("query_id", "row_id")


def _row(scored: DataFrame, objective: str, algorithm: str, regression: bool) -> DataFrame:
    none = F.lit(None).cast("double")
    if regression:
        error = F.col("y") - F.col("predicted")
        out = scored.agg(F.count(F.lit(1)).alias("held_out"), F.avg(error * error).alias("mse"), F.var_pop("y").alias("spread"))
        values = [none.alias("accuracy"), (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2"), "mse"]
    else:
        out = scored.agg(F.count(F.lit(1)).alias("held_out"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
        values = ["accuracy", none.alias("r2"), none.alias("mse")]
    return out.select(F.lit(objective).alias("objective"), F.lit(algorithm).alias("algorithm"), "held_out", *values)


def train_objectives(df: DataFrame, fits: Mapping[str, Fit] = FAST) -> DataFrame:
    """Every objective fitted on its training rows: (objective, algorithm, held_out, accuracy, r2, mse) of the others.

    Objectives whose columns are absent or whose label has a single class are left out.
    """
    parts = []
    for name, fit in fits.items():
        objective = models.OBJECTIVES[name]
        needed = {objective.label, *({"Summary", "Labels"} if name == "alloc" else ())}
        if needed - set(df.columns) or not (name == "alloc" or set(objective.features) & set(df.columns)):
            continue
        if name != "ttr" and df.select(objective.label).distinct().limit(2).count() < 2:
            continue
        if fit.make is None:
            rows = stage(df.select("row_id", "Summary", "Labels", "Original_Estimate_Resource", "Story_Points_Resource", "Assignee_Resource"))
            # codes are learnt on all rows, distances on the training part
            train, test = encode.split_80_20(coded(rows))
            keep = ("row_id", "Assignee_Resource")
            voted = neighbors.knn_vote(neighbors.knn_join(
                encode.standardize(test, C.ALLOC, keep, fit_on=train), encode.standardize(train, C.ALLOC, keep), C.ALLOC, NEIGHBOURS, payload="Assignee_Resource"))
            scored = test.join(voted, F.col("row_id") == F.col("query_id")).select(F.col("Assignee_Resource").alias("y"), F.col("predicted").alias("pred"))
            parts.append(_row(scored, name, fit.algorithm, False))
            continue
        split = models.prepare_split(df, objective, balanced=fit.balanced, one_pass=fit.one_pass)
        model = fit.make(split).fit(split.train)
        scored = models.regress(model, split.test) if name == "ttr" else models.classify(model, split.test)
        parts.append(_row(scored, name, fit.algorithm, name == "ttr"))
    empty = df.sparkSession.createDataFrame([], "objective string, algorithm string, held_out long, accuracy double, r2 double, mse double")
    return reduce(DataFrame.unionByName, parts, empty)


def compare_regressors(split: models.Split, rounds: int = 60) -> DataFrame:
    """Boosted trees against ordinary least squares on time to resolve: (model, r2, mse, rmse, mae), best first."""
    rows = []
    for name, estimator in (("Gradient Boosting", models.gbt_regressor(rounds)), ("Linear Regression", models.ols())):
        scored = models.regress(estimator.fit(split.train), split.test)
        rows.append(metrics.regression_metrics(scored, "y", "predicted").select(F.lit(name).alias("model"), "*"))
    return rows[0].unionByName(rows[1]).orderBy(F.desc("r2"))
