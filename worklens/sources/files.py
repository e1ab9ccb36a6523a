"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row; an empty cell is null. Types are inferred only without a schema."""
    reader = spark.read.option("header", True)
    return reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_text(df: DataFrame, column: str, path: str, keys: Sequence[str] = ()) -> None:
    """One text per row; with ``keys``, in a folder for each of their values."""
    df.select(*keys, column).write.partitionBy(*keys).text(path)
