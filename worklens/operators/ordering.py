"""Order statistics that never sort a whole group in one task.

Values are collapsed to distinct (key, value) rows first, so a hot value costs
one row. Rows are then range-partitioned by (key, order) and written, each with
the number of its partition: a key of any size spans as many partitions as it
fills. Only the totals per key and partition are summed over a key, and exact
order inside a partition comes from a window over it. Where the ranges are cut
decides the balance of the tasks, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from worklens.storage import stage


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    """``df`` plus, for each sum: ``<name>_before`` (strictly earlier rows of the
    key) and ``<name>_total`` (the whole key).

    (keys, order) must identify a row.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = df.withColumns({f"_{n}": (F.col(e) if isinstance(e, str) else e) for n, e in sums.items()})
    # staged, so that a row keeps its partition's number in both passes
    bucketed = stage(summed.repartitionByRange(parts, *keys, *order).withColumn("_bucket", F.spark_partition_id()))
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(f"_{n}").alias(f"_{n}_sum") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_{n}_sum").over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in sums],
        *[F.sum(f"_{n}_sum").over(whole).alias(f"{n}_total") for n in sums])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = bucketed.withColumns({f"_{n}_local": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_{n}_local") + F.col(f"_{n}_offset")).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_total") for n in sums])


def hash_order_rank(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Adds ``rank`` (0-based) in the order of md5(row_id) within each key."""
    hashed = df.withColumn("_h", F.md5(F.col(row_id).cast("string")))
    out = running_totals(hashed, keys, ["_h", row_id], {"n": F.lit(1)})
    return out.withColumn("rank", F.col("n_before")).drop("_h", "n_before", "n_total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key: one row per key, one column per name."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = (df.select(*keys, v.alias("_v")).where("_v is not null")
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n")))
    placed = running_totals(counts, keys, ["_v"], {"n": "n"})
    first, last = F.col("n_before"), F.col("n_before") + F.col("n")
    picks, finals = [], []
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        for side, pos in (("lo", low), ("hi", high)):
            picks.append(F.max(F.when((first <= pos) & (pos < last), F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - low).alias(f"_{name}_part"))
        lo, hi, part = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "part"))
        finals.append((lo + (hi - lo) * part).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *finals)
