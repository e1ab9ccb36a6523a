"""Clustering of resource vectors and isolation-forest anomaly scores."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from worklens.operators.boosting import Block, Together
from worklens.operators.encode import standardize
from worklens.operators.ordering import exact_quantiles
from worklens.storage import stage

# executors get these functions by value and need not have the repository installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: cluster names in ascending order of stress
CLUSTER_NAMES = ("High Performer", "Mid Performer", "Overloaded")
VECTOR = ("workload", "burnout", "sprint_risk", "consec")
MOST_CLUSTERS = 1000


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of every row (the first of equally near ones) and the squared distance to it."""
    d2 = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    at = d2.argmin(axis=1)
    return at, d2[np.arange(len(x)), at]


def lloyd(rows: DataFrame, by: str, k: int, restarts: int, seed: int, most: int = 100) -> np.ndarray:
    """The centers of the best of several k-means runs over (``by``, label, features); all runs share their passes.

    A run starts from the rows with the lowest hashes of (run, number of the center, row), so it does
    not depend on the layout. A pass adds up, for every run and cluster, rows and coordinates.
    """
    x = vector_to_array("features")
    hashed = lambda s, j: F.xxhash64(F.lit(seed + s), F.lit(j), by)
    first = rows.agg(*[F.min_by(x, hashed(s, j)).alias(f"c{s}_{j}") for s in range(restarts) for j in range(k)]).first()
    centers = np.array([[first[f"c{s}_{j}"] for j in range(k)] for s in range(restarts)])
    data, width = Together.of(rows), centers.shape[2]

    def sums(now: np.ndarray):
        def share(b: Block) -> np.ndarray:
            out = np.zeros((restarts, k, width + 2))
            for s in range(restarts):
                at, d2 = _nearest(b.x, now[s])
                for i, column in enumerate((np.ones(len(at)), d2, *b.x.T)):
                    out[s, :, i] = np.bincount(at, weights=column * b.times, minlength=k)
            return out
        return share

    for _ in range(most):
        held = data.total(sums(centers), values=True).reshape(restarts, k, width + 2)
        # a cluster without rows stays where it is
        moved = np.where(held[:, :, :1] > 0, held[:, :, 2:] / np.maximum(held[:, :, :1], 1.0), centers)
        if np.abs(moved - centers).max() < 1e-12:
            break
        centers = moved
    return centers[held[:, :, 1].sum(axis=1).argmin()]


def silhouette(rows: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """The mean silhouette (one row) of a clustering, by squared distances.

    The mean squared distance from a row to a cluster is |x|^2 - 2 x.mean + mean |y|^2, so sums per cluster are all
    that is needed. A row alone in its cluster counts 0, as does a table with a single cluster. There may be at most ``MOST_CLUSTERS`` of them, as their sums go to every row.
    """
    x = [F.col(f).cast("double") for f in features]
    norm = sum((c * c for c in x[1:]), x[0] * x[0])
    per = rows.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("norm"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)])
    found = per.limit(MOST_CLUSTERS + 1).collect()
    if len(found) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    kind = rows.schema[cluster].dataType
    known = F.array(*[F.struct(F.lit(r["_c"]).cast(kind).alias("_c"), *[F.lit(r[c]).alias(c) for c in per.columns[1:]]) for r in found])
    if not found:
        return per.agg(F.avg("norm").alias("silhouette"))
    far = lambda c: norm - 2.0 * sum((v * c[f"m{i}"] for i, v in enumerate(x[1:], 1)), x[0] * c["m0"]) + c["norm"]
    own = F.element_at(F.filter(known, lambda c: c["_c"].eqNullSafe(F.col(cluster))), 1)
    other = F.array_min(F.transform(F.filter(known, lambda c: ~c["_c"].eqNullSafe(F.col(cluster))), far))
    scored = rows.select(F.when(own["n"] > 1, far(own) * own["n"] / (own["n"] - 1)).alias("a"), other.alias("b"))
    return scored.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def cluster_resources(vectors: DataFrame, by: str, k: int = 3, restarts: int = 10, seed: int = 42) -> DataFrame:
    """k-means on standardised vectors, best of several runs, clusters ordered by stress."""
    z = stage(standardize(stage(vectors), VECTOR, keep=(by, *[F.col(c).alias(f"raw_{c}") for c in VECTOR])))
    k = min(k, z.limit(k).count())
    if k < 2:
        return vectors.withColumns({"cluster": F.lit(0), "cluster_name": F.lit(CLUSTER_NAMES[0]),
                                    "silhouette": F.lit(None).cast("double")})
    rows = z.select(by, F.lit(0.0).alias("label"), array_to_vector(F.array(*VECTOR)).alias("features"))
    centers = lloyd(rows, by, k, restarts, seed)
    centers = centers[np.argsort(centers.mean(axis=1), kind="stable")]
    far = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(VECTOR, center, strict=True)), F.lit(0.0)) for center in centers]
    d2 = F.array(*far)
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    labelled = z.withColumn("cluster", (F.array_position(d2, F.array_min(d2)) - 1).cast("int"))
    return labelled.select(by, *[F.col(f"raw_{c}").alias(c) for c in VECTOR], "cluster", names[F.col("cluster")].alias("cluster_name"),
                           silhouette(labelled, VECTOR).select("silhouette").scalar().alias("silhouette"))


def _average_path(n: np.ndarray | int):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    h = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    return np.where(n > 2, 2.0 * h - 2.0 * (n - 1.0) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def _build(seed: int, depth_limit: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("row_id")["f"].to_numpy())
        rng = np.random.default_rng([seed, t])
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            spread = rows.max(axis=0) - rows.min(axis=0)
            open_dims = np.nonzero(spread > 0)[0]
            if depth >= depth_limit or len(rows) <= 1 or len(open_dims) == 0:
                nodes[at] = (t, at, -1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
                return at
            dim = int(rng.choice(open_dims))
            cut = float(rng.uniform(rows[:, dim].min(), rows[:, dim].max()))
            left = rows[:, dim] <= cut
            a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
            nodes[at] = (t, at, dim, cut, a, b, 0.0)
            return at

        grow(x, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "dim", "cut", "left", "right", "path"])

    return build


def tree_samples(rows: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``rows`` of each tree: the ``sample`` rows of the whole table with the lowest hashes of (seed, tree, row_id).

    Only rows under a cut that leaves about twice as many to each tree are multiplied, so a large
    table is not (a tree falls short of its sample by a deviation of eleven).
    """
    cut = math.ceil(2 * sample / max(1, rows.count()) * (1 << 32))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows.rdd.getNumPartitions() < parts:
        # a few MB of ids are much hashing: every core gets a part of them
        rows = rows.repartition(parts, "row_id")
    # rows of generated code, not elements of an array: pairs of row and tree only stream by
    draw = F.md5(F.concat_ws("/", F.col("_tree"), F.col("_id")))
    drawn = (rows.withColumn("_id", F.col("row_id").cast("string"))
             .select("*", F.posexplode(F.array(*[F.lit(f"{seed}/{t}") for t in range(trees)])).alias("tree", "_tree")))
    if cut < 1 << 32:
        # digits of a hash compare like its number
        drawn = drawn.where(draw < F.lit(f"{cut:08x}"))
    # the group limit is applied before the shuffle
    order = Window.partitionBy("tree").orderBy(draw, "row_id")
    return drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).drop("at", "_id", "_tree")


def _packed(nodes: pd.DataFrame, width: int) -> tuple:
    """A tree for scoring: its depth, and per node its dimension, cut, children (right, left) and path; a leaf leads to itself."""
    dim, cut, left, right, path = (nodes[c].to_numpy() for c in ("dim", "cut", "left", "right", "path"))
    leaf, here, deep, level = dim < 0, np.arange(len(dim)), 0, np.zeros(1, dtype=np.int64)
    turn = np.stack([np.where(leaf, here, right), np.where(leaf, here, left)], axis=1).astype(np.int64)
    while not leaf[level].all():
        deep, level = deep + 1, np.unique(turn[level])
    return deep, np.clip(dim, 0, width - 1).astype(np.int64), cut, turn.ravel(), path


def isolation_scores(df: DataFrame, features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """row_id and score in [-1, 0): lower is more isolated (Liu, Ting and Zhou, 2008).

    The trees grow on ``tree_samples``; the forest (trees x at most 511 nodes) is shipped to the scoring tasks.
    """
    spark = df.sparkSession
    rows = stage(df.select("row_id", F.array(*[F.col(f).cast("double") for f in features]).alias("f")), by="row_id")
    n = rows.count()
    picked = tree_samples(rows, trees, sample, seed).select("tree", "row_id", "f")
    psi = max(2, min(sample, n))
    schema = "tree int, node int, dim int, cut double, left int, right int, path double"
    forest = picked.groupBy("tree").applyInPandas(_build(seed, math.ceil(math.log2(psi))), schema).toPandas()
    packed = [_packed(part.sort_values("node"), len(features)) for _, part in forest.groupby("tree", sort=True)]
    shipped = spark.sparkContext.broadcast(packed)
    scale = float(_average_path(psi))

    @F.pandas_udf("double")
    def score(points: pd.Series) -> pd.Series:
        x = np.stack(points.to_numpy()) if len(points) else np.zeros((0, 1))
        total = np.zeros(len(x))
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        for deep, dim, cut, turn, path in shipped.value:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(deep):
                at = turn.take(2 * at + (flat.take(start + dim.take(at)) <= cut.take(at)))
            total += path.take(at)
        return pd.Series(-np.exp2(-(total / max(len(shipped.value), 1)) / scale))

    return rows.select("row_id", score("f").alias("score"))


def anomaly_flags(df: DataFrame, features: Sequence[str], contamination: float = 0.05, **options) -> DataFrame:
    """Scores with a flag on rows strictly below the exact quantile at ``contamination``."""
    scores = stage(isolation_scores(df, features, **options))
    limit = exact_quantiles(scores, [], "score", {"limit": contamination}).select("limit").scalar()
    return scores.withColumn("anomaly", (F.col("score") < limit).cast("int"))


def anomaly_topk(flags: DataFrame, k: int = 10) -> DataFrame:
    """The most isolated rows."""
    return flags.where("anomaly = 1").orderBy("score", "row_id").limit(k)
