"""Shared-folder staging: cutting lineage without relying on executor-local blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Mapping

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="worklens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Streams compressed bytes through heap; codecs that take a page whole keep off-heap buffers of its size.
PACKED = {"compression": "zstd"}
#: For rows of megabytes: pages and row groups are cut after any row, not after a hundred.
WIDE = PACKED | {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def stage(df: DataFrame, by: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and scan it from there.

    Used before multi-pass work (iterative fits): every pass then reads pruned
    columns from files instead of recomputing the plan, and survives lost executors.
    ``by`` spreads the rows over all shuffle partitions first, so that later passes
    use every core and the layout does not depend on the input's. ``options`` of the files: sizes of
    files decide how a scan deals them, on which the draws of forests depend.
    """
    spark = df.sparkSession
    if by:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    path = f"{shared_dir(spark)}/worklens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def stage_packed(df: DataFrame) -> DataFrame:
    """``stage`` with smaller files."""
    return stage(df, options=PACKED)


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read again, and the shuffle files of plans that are gone."""
    for table in tables:
        drop(table.sparkSession, table._staged)
    # shuffle files stay until the driver finds that nothing refers to them
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def kept(spark: SparkSession, rows: RDD) -> tuple[str, RDD]:
    """``rows`` written to object files in the shared folder, one object at a time, and read from there: their path and an RDD."""
    path = f"{shared_dir(spark)}/worklens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    rows.saveAsPickleFile(path, 1)
    return path, spark.sparkContext.pickleFile(path, 1)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
