"""Evaluation metrics over prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from worklens.functions import ratio
from worklens.operators.ordering import running_totals

# fixed value: below this accuracy a model is reported as low signal
LOW_SIGNAL = 0.60


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the averages.

    Everything after the confusion counts works on at most classes^2 rows.
    """
    confusion = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    scored = per_class.select(
        F.col("label").cast("string").alias("label"), "support", "hits",
        ratio(F.col("hits") * 1.0, F.col("predicted"), 0.0).alias("precision"),
        ratio(F.col("hits") * 1.0, F.col("support"), 0.0).alias("recall"),
    ).withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall"), 0.0))
    measures = ("precision", "recall", "f1")
    total = scored.agg(
        F.sum("support").alias("support"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in measures])
    none = F.lit(None).cast("double")
    low = F.when(F.col("accuracy") < LOW_SIGNAL, "low signal").otherwise("")
    summary = total.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("support").alias("support"), low.alias("note")),
        *[F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                   F.col("support").alias("support"), F.lit("").alias("note")) for kind in ("macro", "weighted")],
    )).alias("s")).select("s.*")
    rows = scored.select("label", *measures, "support", F.lit("").alias("note"))
    return rows.unionByName(summary)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Exact Mann-Whitney area, ties counted half.

    Scores are collapsed to one row per distinct value before anything is ordered.
    """
    hit = F.col(y) == 1
    per_score = df.groupBy(F.col(p).cast("double").alias("p")).agg(
        F.sum(F.when(hit, 1).otherwise(0)).alias("pos"), F.sum(F.when(hit, 0).otherwise(1)).alias("neg"))
    placed = running_totals(per_score, [], ["p"], {"pos": "pos", "neg": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_before").cast("double") + F.col("neg") / 2.0))
    return placed.agg(F.try_divide(wins, F.max(F.col("pos_total").cast("double") * F.col("neg_total"))).alias("auc"))


def brier_score(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def regression_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    error = F.col(y) - F.col(predicted)
    out = df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("spread"))
    return out.select((F.lit(1.0) - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2"), "mse",
                      F.sqrt("mse").alias("rmse"), "mae")
