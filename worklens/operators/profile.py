"""Column profile and numeric description.

Columns are melted to (column, value) before anything is counted, so a
distinct count shuffles two narrow fields per distinct value instead of a wide
row per column, and the table is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from worklens.functions import round_half_up
from worklens.operators.ordering import exact_quantiles


def _melt(df: DataFrame, cols: list[str], as_type: str) -> DataFrame:
    return (df.select(*[F.col(c).cast(as_type).alias(c) for c in cols])
            .unpivot([], cols, "column_name", "value"))


def _shown_type(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "StringType"
    return "DoubleType" if isinstance(t, (T.FloatType, T.DoubleType)) else "IntegerType"


def _canonical(name: str, shown: str) -> Column:
    """A value as text, such that values are equal if and only if their texts are (0.0 and -0.0, and all NaN, are one)."""
    if shown == "DoubleType":
        return (F.col(name).cast("double") + 0.0).cast("string")
    return F.col(name).cast("bigint" if shown == "IntegerType" else "string").cast("string")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, null count and distinct non-null count of every column, from one melt of the table."""
    shown = {f.name: _shown_type(f.dataType) for f in df.schema.fields}
    melted = df.select(*[_canonical(c, t).alias(c) for c, t in shown.items()]).unpivot([], list(shown), "column_name", "value")
    if approximate:
        counted = melted.groupBy("column_name").agg(
            F.count_if(F.col("value").isNull()).alias("nulls"), F.approx_count_distinct("value").alias("distinct_values"))
    else:
        per_value = melted.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = per_value.groupBy("column_name").agg(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    types = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return counted.select("column_name", types[F.col("column_name")].alias("spark_type"), F.col("nulls").cast("bigint").alias("nulls"), "distinct_values")


def describe_numeric(df: DataFrame, n: int = 8) -> DataFrame:
    """Count, mean, sample deviation and exact quartiles of the first ``n`` numeric columns."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)][:n]
    melted = _melt(df, cols, "double")
    moments = melted.groupBy("column_name").agg(
        F.count("value").alias("records"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(melted, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    both = moments.join(quartiles, "column_name")
    return both.select("column_name", "records", *[
        round_half_up(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])
