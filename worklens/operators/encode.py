"""Feature transforms: scaling, dictionaries, one-hot, splits, folds, class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.operators.ordering import hash_order_rank, running_totals
from worklens.storage import stage


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("row_id",),
                fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred.

    The one-row statistics (of ``fit_on``, by default ``df``) enter the scan as a
    scalar subquery.
    """
    stats = (df if fit_on is None else fit_on).agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(f"{c}_m") for c in cols],
                            *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_s") for c in cols]).alias("s")).scalar()

    def z(c: str) -> Column:
        spread = stats[f"{c}_s"]
        return ((F.col(c) - stats[f"{c}_m"]) / F.when(spread == 0.0, 1.0).otherwise(spread)).alias(c)

    return df.select(*keep, *[z(c) for c in cols])


def category_dict(df: DataFrame, column: str) -> DataFrame:
    """(value, code) with codes 0.. in sorted order."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return running_totals(values, [], ["value"], {"n": F.lit(1)}).select("value", F.col("n_before").cast("int").alias("code"))


def encode(df: DataFrame, column: str, dictionary: DataFrame, alias: str) -> DataFrame:
    """Left join on the dictionary (broadcast when its measured size allows); a value it lacks gets code 0."""
    side = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(side, F.col(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(alias, F.coalesce("_code", F.lit(0))).drop("_value", "_code")


def label_encode(df: DataFrame, columns: Mapping[str, str], fit_on: DataFrame | None = None) -> DataFrame:
    """``columns`` maps a source column to the name of its code column."""
    for column, alias in columns.items():
        df = encode(df, column, category_dict(df if fit_on is None else fit_on, column), alias)
    return df


def one_hot(levels: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """``<column>_<level>`` -> 0/1, every level kept, levels in sorted order."""
    return {f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, vs in levels.items() for v in sorted(vs)}


def levels_of(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """The distinct values of columns that are to become indicator columns."""
    out = {}
    for c in columns:
        found = [row[0] for row in df.select(c).where(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"{c} has more than {limit} values; encode it instead of one-hot")
        out[c] = sorted(found)
    return out


def split_bucket(row_id: str = "row_id", parts: int = 5) -> Column:
    """A part number from the hash of the row id: the same on every run and layout."""
    return F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("bigint") % parts


def split_80_20(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = split_bucket()
    return df.where(part != 0), df.where(part == 0)


def stratified_split(df: DataFrame, label: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same class shares: in hash order every ``parts``-th row of a class is a test row.

    Classes are ranked by range partitions, so a class of any size spans several tasks.
    """
    dealt = stage(stratified_folds(df, label, parts))
    return dealt.where("fold <> 0").drop("fold"), dealt.where("fold = 0").drop("fold")


def stratified_rows(df: DataFrame, label: str) -> DataFrame:
    part = stratified_folds(df.select("row_id", label), label)
    return part.select("row_id", label, F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))


def split_rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.when(split_bucket() == 0, "test").otherwise("train").alias("part"))


def stratified_folds(df: DataFrame, label: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``: rows of every class dealt round-robin in hash order."""
    return (hash_order_rank(df, [label]).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class), one row per class."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("records"))
    every = Window.partitionBy()
    return per_class.withColumn(
        "weight", F.sum("records").over(every) / (F.count(F.lit(1)).over(every) * F.col("records")))


def binary_weight(df: DataFrame, label: str) -> Column:
    """The balanced class weight of a 0/1 label as a row expression."""
    return weight_at(df.agg(F.avg(F.col(label).cast("double")).alias("s")).first()["s"], label)


def weight_at(share: float | None, label: str) -> Column:
    """The balanced class weight where ``share`` of the rows have label 1."""
    if share is None or share in (0.0, 1.0):
        raise ValueError(f"{label} has a single class")
    return F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1.0 - share))
