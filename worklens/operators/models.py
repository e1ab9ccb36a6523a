"""Supervised models on MLlib: objective definitions, fitting and batch scoring.

Scaling is part of the fitted pipeline and is learnt on training rows only.
Defaults keep the usual settings (80 trees of depth 3 and the like); callers
shrink them for smoke runs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F, types as T

from worklens import columns as C
from worklens.operators import encode
from worklens.operators.boosting import Boosting, Softmax
from worklens.operators.features import engineer_features
from worklens.operators.prep import col_or_zero, present
from worklens.storage import stage

SEED = 42
MAX_BINS = 64
#: Estimators that read their rows about once.
ONE_PASS = (NaiveBayes, LinearRegression)


@dataclass(frozen=True)
class Objective:
    name: str
    label: str
    features: tuple[str, ...]
    # factor -> its levels; None means: look them up in the data
    one_hot: Mapping[str, Sequence[str] | None] = field(default_factory=dict)


OBJECTIVES = {
    "sprint": Objective("sprint", "Success_Label", C.BASE_SPRINT),
    "workload": Objective("workload", "Expected_Overload", C.WORKLOAD),
    "ttr": Objective("ttr", "Resolution_Time_Hours", C.TTR_NUMERIC, {"Issue_Type": None, "Priority": None}),
    "burnout": Objective("burnout", "Risk_Flag", C.BURNOUT),
    "alloc": Objective("alloc", "Assignee_Resource", C.ALLOC),
}


def training_table(df: DataFrame, objective: Objective, extra: Sequence[str] = (),
                   drop_first: bool = False) -> tuple[DataFrame, list[str]]:
    """(row_id, label, feature columns) of an objective, and the feature names.

    ``extra`` names engineered or novel features. ``drop_first`` leaves out one
    level per factor, which a normal-equation solver with intercept needs.
    Feature columns the table lacks are skipped.
    """
    if extra:
        df = engineer_features(df, novel=any(e in C.NOVEL for e in extra))
    if objective.name == "alloc":
        df = encode.label_encode(df, {"Summary": "Summary_enc", "Labels": "Labels_enc"})
    levels = {c: sorted(v or encode.levels_of(df, [c])[c])[1 if drop_first else 0:]
              for c, v in objective.one_hot.items() if c in df.columns}
    flags = encode.one_hot(levels)
    numeric = present(df, [*objective.features, *extra])
    names = [*flags, *numeric]
    return df.select("row_id", F.col(objective.label).alias("label"), *[e.alias(n) for n, e in flags.items()],
                     *[F.col(n).cast("double").alias(n) for n in numeric]), names


def label_classes(df: DataFrame, objective: Objective) -> list[str] | None:
    """The sorted classes of a label of text; None for a numeric label."""
    if not isinstance(df.schema[objective.label].dataType, T.StringType):
        return None
    return encode.levels_of(df, [objective.label])[objective.label]


def with_label_codes(df: DataFrame, objective: Objective, classes: Sequence[str] | None) -> DataFrame:
    """The label as its place among the classes; rows without a label are left out."""
    if classes is None:
        return df
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(objective.label)) - 1
    return df.where(F.col(objective.label).isNotNull()).withColumn(objective.label, code.cast("int"))


def fit_scaler(mean: Sequence[float], spread: Sequence[float], n: int, names: Sequence[str], spark) -> PipelineModel:
    """Assembler and scaler of ``n`` rows of these means and sample deviations; the scaler divides by the population deviation."""
    # two rows of the same mean and deviation teach MLlib's scaler what a pass over vectors of all rows would
    ends = [Vectors.dense([m + side * s / math.sqrt(2.0) for m, s in zip(mean, spread, strict=True)]) for side in (-1.0, 1.0)]
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(spark.createDataFrame([(e,) for e in ends], ["_raw"]))
    up = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    return PipelineModel(stages=[
        VectorAssembler(inputCols=list(names), outputCol="_raw"), scaler,
        ElementwiseProduct(inputCol="_z", outputCol="features", scalingVec=Vectors.dense([up] * len(names))),
    ])


def learn(train: DataFrame, names: Sequence[str], balanced: bool) -> tuple[int, PipelineModel, Column]:
    """Number, scaler and weight of training rows, from one aggregation of plain columns."""
    found = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("share"),
                      F.array(*[F.avg(c) for c in names]).alias("mean"),
                      F.array(*[F.stddev_samp(c) for c in names]).alias("spread")).first()
    if not found["n"]:
        raise ValueError("there are no training rows")
    mean, spread = ([v or 0.0 for v in found[k]] for k in ("mean", "spread"))
    weight = encode.weight_at(found["share"], "label") if balanced else F.lit(1.0)
    return found["n"], fit_scaler(mean, spread, found["n"], names, train.sparkSession), weight


def _staged_split(table: DataFrame, stratified: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the staged table; the hash of a row's id is taken once, not per pass."""
    if stratified:
        return encode.stratified_split(stage(table, by="row_id"), "label")
    table = stage(table.withColumn("_part", encode.split_bucket()), by="row_id")
    return table.where("_part <> 0").drop("_part"), table.where("_part = 0").drop("_part")


@dataclass
class Split:
    """Train and test rows (row_id, label, features vector, weight)."""

    train: DataFrame
    test: DataFrame
    scaler: PipelineModel
    names: list[str]
    n_train: int
    # names of the label codes 0, 1, ... where the label was text
    classes: list[str] | None = None


def _vectors(df: DataFrame, scaler: PipelineModel, weight: Column) -> DataFrame:
    return scaler.transform(df).select("row_id", F.col("label").cast("double").alias("label"), "features",
                                       weight.alias("weight"))


def prepare_split(df: DataFrame, objective: Objective, extra: Sequence[str] = (), balanced: bool = False,
                  drop_first: bool = False, stratified: bool = False, one_pass: bool = False) -> Split:
    """80/20 hash split (with equal class shares if ``stratified``), scaled on the training part and staged for repeated passes.

    ``one_pass``: the training vectors are read about once, so they are not staged; their rows are.
    """
    classes = label_classes(df, objective)
    table, names = training_table(with_label_codes(df, objective, classes), objective, extra, drop_first)
    train, test = _staged_split(table, stratified)
    n, scaler, weight = learn(train, names, balanced)
    train_v = _vectors(train, scaler, weight)
    return Split(train_v if one_pass else stage(train_v, by="row_id"), _vectors(test, scaler, F.lit(1.0)), scaler, names, n, classes)


# -- estimators ----------------------------------------------------------------

def logistic(total_weight: float, weighted: bool = False, max_iter: int = 300, c: float = 1.0) -> Estimator:
    """Ridge-penalised logistic regression with inverse penalty ``c`` on scaled features."""
    est = LogisticRegression(regParam=1.0 / (c * total_weight), elasticNetParam=0.0, standardization=False,
                             maxIter=max_iter)
    return est.setWeightCol("weight") if weighted else est


def tree(max_depth: int = 6, weighted: bool = True, min_leaf: int = 10) -> Estimator:
    est = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=MAX_BINS, seed=SEED)
    return est.setWeightCol("weight") if weighted else est


def forest(trees: int = 100, max_depth: int = 10, weighted: bool = False) -> Estimator:
    # the nodes of a row are kept between levels, so that deep trees are not walked again at every level
    est = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, maxBins=MAX_BINS, seed=SEED, cacheNodeIds=True)
    return est.setWeightCol("weight") if weighted else est


def gbt(rounds: int = 80, max_depth: int = 3, step: float = 0.1) -> Boosting:
    return Boosting(rounds, max_depth, step)


def gbt_regressor(rounds: int = 80, max_depth: int = 3, step: float = 0.1) -> Boosting:
    return Boosting(rounds, max_depth, step, logistic=False)


def softmax(classes: int = 2, weighted: bool = False, c: float = 1.0) -> Softmax:
    """The same objective as ``logistic``, for any number of classes, by Newton's method."""
    return Softmax(classes, c, weighted)


def gaussian_nb() -> Estimator:
    return NaiveBayes(modelType="gaussian")


def ols() -> Estimator:
    return LinearRegression(solver="normal", regParam=0.0)


def ridge(n: int, label_deviation: float, alpha: float = 1.0) -> Estimator:
    """``alpha`` as a penalty on the summed squared error of scaled features.

    MLlib divides its penalty by the label's deviation, hence the factor.
    """
    return LinearRegression(solver="normal", regParam=alpha / n * label_deviation, elasticNetParam=0.0,
                            standardization=False)


# -- scoring ---------------------------------------------------------------------

def classify(model: Model, rows: DataFrame) -> DataFrame:
    """row_id, y, pred, p = P(class 1)."""
    out = model.transform(rows)
    return out.select("row_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability")[1].alias("p"))


def regress(model: Model, rows: DataFrame) -> DataFrame:
    """row_id, y, predicted; durations cannot be negative."""
    return model.transform(rows).select("row_id", F.col("label").alias("y"),
                                        F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted"))


def feature_importance(model: Model, spark, names: Sequence[str]) -> DataFrame:
    """Impurity importances, largest first, flagged when above their mean."""
    values = (model.importances if hasattr(model, "importances") else model.featureImportances.toArray()).tolist()
    rows = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    mean = sum(values) / len(values)
    return rows.withColumn("above_mean", F.col("importance") > mean).orderBy(F.desc("importance"), "feature")


def label_deviation(train: DataFrame) -> float:
    return train.agg(F.stddev_pop("label").alias("s")).first()["s"]


def fit_pipeline(df: DataFrame, objective: Objective, make, balanced: bool = False,
                 extra: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on the training part; returns (scaler + model, train, test) over plain feature columns.

    ``make(n, train_vectors)`` builds the estimator.
    """
    table, names = training_table(df, objective, extra)
    train, test = _staged_split(table)
    n, scaler, weight = learn(train, names, balanced)
    vectors = _vectors(train, scaler, weight)
    estimator = make(n, vectors)
    # means and normal equations come from one pass, all others read their rows again and again
    model = estimator.fit(vectors if isinstance(estimator, ONE_PASS) else stage(vectors, by="row_id"))
    return PipelineModel(stages=[*scaler.stages, model]), train, test


def fitted_inputs(df: DataFrame, objective: Objective, names: Sequence[str]) -> dict[str, Column]:
    """The features a pipeline was fitted on, for rows that need no label.

    Absent columns and missing values count as 0; a category unknown to the fit sets no indicator.
    """
    def value(name: str) -> Column:
        for c in objective.one_hot:
            if name.startswith(f"{c}_"):
                return F.when(F.col(c) == name[len(c) + 1:], 1.0).otherwise(0.0) if c in df.columns else F.lit(0.0)
        return F.coalesce(col_or_zero(df, name).cast("double"), F.lit(0.0))

    return {name: value(name) for name in names}


def _scored_rows(df: DataFrame, objective: Objective, model: PipelineModel) -> DataFrame:
    """The row as one struct ``_row``, beside its inputs and what the pipeline adds."""
    names = model.stages[0].getInputCols()
    derived = set(names) & {*C.ENGINEERED, *C.NOVEL}
    if derived - set(df.columns):
        df = engineer_features(df, novel=bool(derived & set(C.NOVEL)))
    inputs = fitted_inputs(df, objective, names)
    return model.transform(df.select(F.struct("*").alias("_row"), *[e.alias(n) for n, e in inputs.items()]))


def with_predictions(df: DataFrame, fitted: Mapping[str, PipelineModel]) -> DataFrame:
    """``df`` plus ``pred_<objective>`` and ``p_<objective>`` of every fitted 0/1 classifier; no shuffle."""
    for name, model in fitted.items():
        df = _scored_rows(df, OBJECTIVES[name], model).select(
            "_row.*", F.col("prediction").cast("int").alias(f"pred_{name}"), vector_to_array("probability")[1].alias(f"p_{name}"))
    return df


def score_scenarios(df: DataFrame, fitted: Mapping[str, PipelineModel], suggested: DataFrame | None = None) -> DataFrame:
    """All scenarios under all fitted objectives: (row_id, objective, prediction, p, delta, suggestion).

    Scenarios need no label and may lack features. ``delta`` is predicted minus estimated
    hours for time-to-resolve. ``suggested`` (row_id, predicted) adds the suggested assignee.
    """
    none = F.lit(None).cast("double")
    parts = [] if suggested is None else [suggested.select(
        "row_id", F.lit("alloc").alias("objective"), none.alias("prediction"), none.alias("p"), none.alias("delta"), F.col("predicted").alias("suggestion"))]
    for name, model in fitted.items():
        out = _scored_rows(df, OBJECTIVES[name], model).withColumn("row_id", F.col("_row.row_id"))
        if name == "ttr":
            hours = F.greatest(F.col("prediction"), F.lit(0.0))
            estimate = F.coalesce("_row.Original_Estimate_Hours", F.lit(0.0)) if "Original_Estimate_Hours" in df.columns else F.lit(0.0)
            out = out.select("row_id", F.lit(name).alias("objective"), hours.alias("prediction"),
                             F.lit(None).cast("double").alias("p"), (hours - estimate).alias("delta"))
        else:
            out = out.select("row_id", F.lit(name).alias("objective"), F.col("prediction"),
                             vector_to_array("probability")[1].alias("p"), F.lit(None).cast("double").alias("delta"))
        parts.append(out.withColumn("suggestion", F.lit(None).cast("string")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
