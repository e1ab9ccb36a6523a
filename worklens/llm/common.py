"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.storage import stage


def ship(module: str) -> None:
    """Send this module's functions to executors by value: they need not have the repository installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The text as UTF-8 bytes, a null as no bytes."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batch: pa.RecordBatch, step: int = 512) -> Iterator[list]:
    """The rows of a batch as tuples of Python values, a few hundred at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def kept_by_worker(key: tuple, make):
    """``make()``, kept by this Python worker for its later tasks: tables and caches whose size is bounded.

    A new worker makes its own, so nothing depends on it.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget(kind: str) -> None:
    """Drop what this Python worker keeps under keys that begin with ``kind``."""
    kept = getattr(sys.modules.get("_kept_by_worker"), "__dict__", {})
    for key in [key for key in kept if isinstance(key, tuple) and key[0] == kind]:
        del kept[key]


def few(df: DataFrame) -> DataFrame:
    """Two tasks a core: enough for rows on links, which are few beside the documents, without a file for each shuffle partition."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of the links (a, b): every node that has a link, with the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014). A step only takes
    minima per node (combined before the shuffle) and joins them back, so a hub is never
    gathered in one task; each step is a table in the shared folder. Raises if the
    links have not settled after ``max_rounds``.
    """
    state = stage(few(few(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")).distinct()))
    before = None
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage(few(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = few(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")))
        state = stage(few(small.select("e.a", "e.b").where("a <> b").distinct()))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links have not settled")
    both = state.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("e"))
    return stage(few(both.select("e.node", "e.root").distinct()))


__all__ = ["components", "few", "forget", "kept_by_worker", "partitions", "rows_of", "ship", "stage", "table", "utf8"]
