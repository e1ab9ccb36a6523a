"""Cleaning and shaping of the wide table: null fill, label binarisation, alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from worklens.columns import LABEL_THRESHOLDS
from worklens.functions import band_confidence


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The subset of ``cols`` that ``df`` has, in the given order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def col_or_zero(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0.0)


def group_key(df: DataFrame, preferred: str = "Assignee", fallback: str = "Assignee_Resource") -> str:
    """The person column, with the fallback used when a file lacks the first one."""
    for name in (preferred, fallback):
        if name in df.columns:
            return name
    raise ValueError(f"neither {preferred} nor {fallback} is a column")


def fill_missing(df: DataFrame) -> DataFrame:
    """Null -> 0, and '0' in string columns."""
    def filled(f: T.StructField) -> str:
        name, kind = f"`{f.name}`", f.dataType.simpleString()
        if isinstance(f.dataType, T.StringType):
            return f"coalesce({name}, '0') as {name}"
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return f"coalesce(nanvl({name}, cast(0 as {kind})), cast(0 as {kind})) as {name}"
        if isinstance(f.dataType, T.NumericType):
            return f"coalesce({name}, cast(0 as {kind})) as {name}"
        return name

    return df.selectExpr(*[filled(f) for f in df.schema.fields])


def binarize_labels(df: DataFrame, thresholds: Mapping[str, float] = LABEL_THRESHOLDS) -> DataFrame:
    """'Yes' or a value above the threshold -> 1, everything else -> 0.

    The branch follows the column type; columns that are absent are skipped.
    """
    def flag(f: T.StructField) -> str:
        name = f"`{f.name}`"
        if f.name not in thresholds:
            return name
        hit = (f"{name} = 'Yes'" if isinstance(f.dataType, T.StringType)
               else f"{name} > cast({thresholds[f.name]} as double)")
        return f"if({hit}, 1, 0) as {name}"

    return df.selectExpr(*[flag(f) for f in df.schema.fields])


def prepare(df: DataFrame) -> DataFrame:
    return binarize_labels(fill_missing(df))


def align(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ("row_id",)) -> DataFrame:
    """Exactly the trained feature list: absent columns are 0, extra ones dropped."""
    return df.select(*present(df, keep),
                     *[col_or_zero(df, f).cast("double").alias(f) for f in features])


def rule_prediction(df: DataFrame) -> DataFrame:
    """The deterministic prediction used to exercise metrics: percent done as P(success)."""
    p = F.col("Percent_Done") / 100.0
    return df.select("row_id", F.col("Success_Label").alias("y"),
                     (p > 0.5).cast("int").alias("pred"), p.alias("p"))


def confidence_rows(pred: DataFrame) -> DataFrame:
    return pred.select("row_id", "pred", "p", band_confidence(F.col("pred"), F.col("p")).alias("confidence"))


def preview(df: DataFrame, n: int = 5, by: str = "row_id") -> DataFrame:
    return df.orderBy(by).limit(n)
