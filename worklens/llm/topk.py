"""Exact top-k inner-product search, a block of documents at a time.

Vectors are whole numbers. They are cut into blocks of ``BLOCK`` rows by ranges of ids; a block
keeps its vectors (forward index) and the largest and smallest value of every dimension, whose
products with a query, summed, bound every score in the block. Slices of blocks meet chunks of
queries; in each such cell a query takes its blocks in the order of their bounds and stops
once the next bound is below its k-th score so far. A bound equal to it is still scored, as a
tie may have a smaller id. The best of all slices are merged per query.

Edge cases: rows with a null id, a null vector, or null or non-finite components take no part. Repeated rows
are candidates of their own, but a query is asked once; a query's own id is no candidate. Vectors of different lengths are padded with zeros. Fewer than k candidates give fewer rows;
an empty table gives none. Scores must fit in 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from worklens.llm.common import partitions, ship, stage, table

ship(__name__)

SCALE = 64
TOP = 20
EVERY = 20
BLOCK = 1024
SLICE_BLOCKS = 16
CHUNK = 1024
_BLOCK = "block long, n int, ids binary, vectors binary, high binary, low binary"


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where one is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(~F.exists(vector, bad), F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def blocker(width: int, rows: int):
    """Blocks of a range of ids, in order; a block's number is its partition's times 2^32 and its own."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, part, number = [], [], 0, 0

        def block() -> pa.RecordBatch:
            m = np.zeros((len(ids), width), dtype=np.int64)
            for i, v in enumerate(vectors):
                m[i, :len(v)] = v
            row = [(part << 32) + number, len(ids), np.array(ids, dtype=np.int64).tobytes(), m.tobytes(), m.max(axis=0).tobytes(), m.min(axis=0).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x]) if i != 1 else pa.array([x], pa.int32()) for i, x in enumerate(row)],
                                              names=["block", "n", "ids", "vectors", "high", "low"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                vectors.append(np.asarray(batch.column(1)[i].values))
                part = batch.column(2)[i].as_py()
                if len(ids) == rows:
                    yield block()
                    ids, vectors, number = [], [], number + 1
        if ids:
            yield block()
    return blocks


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y.T: by floating point while every partial sum is below 2^53."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2 ** 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def search(queries: np.ndarray, own: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Top k of every query over the blocks (ids, vectors, high, low): lists of scores and ids, and how many blocks were scored."""
    none = np.zeros(0, dtype=np.int64)
    top = [(none, none)] * len(queries)
    high, low = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    bounds = products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, scored = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        bound = bounds[live, order[live, turn]]
        open_ = np.array([len(top[q][0]) < k or b >= top[q][0][-1] for q, b in zip(live, bound, strict=True)], dtype=bool)
        live = live[open_]  # later bounds of a query are no larger
        for number in np.unique(order[live, turn]):
            asked = live[order[live, turn] == number]
            ids, vectors = blocks[number][:2]
            scores = products(queries[asked], vectors)
            scored += len(asked)
            for q, s in zip(asked, scores, strict=True):
                floor = top[q][0][-1] if len(top[q][0]) == k else None
                keep = ids != own[q] if floor is None else (s >= floor) & (ids != own[q])
                if keep.any():
                    new = best(s[keep], ids[keep], k)
                    top[q] = best(np.concatenate([top[q][0], new[0]]), np.concatenate([top[q][1], new[1]]), k)
    return top, scored


def searcher(k: int):
    def cell(key, chunk: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(chunk) and len(slice_):
            load = lambda b: np.frombuffer(b, dtype=np.int64)
            blocks = [(load(r.ids), load(r.vectors).reshape(r.n, -1), load(r.high), load(r.low)) for r in slice_.itertuples()]
            own = chunk["vec_id"].to_numpy(dtype=np.int64)
            queries = np.zeros((len(own), blocks[0][1].shape[1]), dtype=np.int64)
            for i, v in enumerate(chunk["ints"]):
                queries[i, :len(v)] = v
            for q, (scores, ids) in zip(own, search(queries, own, blocks, k)[0], strict=True):
                out["query_id"] += [q] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out, dtype="int64")
    return cell


def top_k(vectors: DataFrame, asked: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id, ints); queries are the rows where ``asked`` holds."""
    spark = vectors.sparkSession
    rows = stage(vectors.where("vec_id is not null and ints is not null"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("ints")).alias("width"), F.count(F.when(asked, 1)).alias("queries")).first()
    if not facts["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    made = (rows.repartitionByRange(min(partitions(spark), -(-facts["n"] // BLOCK)), "vec_id").sortWithinPartitions("vec_id")
            .select("vec_id", "ints", F.spark_partition_id().alias("part")).mapInArrow(blocker(facts["width"], BLOCK), _BLOCK))
    blocks = stage(made)
    slices = max(1, -(-blocks.count() // SLICE_BLOCKS))
    chunks = -(-facts["queries"] // CHUNK)
    slice_ = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")
    laid = blocks.withColumn("slice", slice_).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = (rows.where(asked).distinct().withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    found = (asks.groupBy("slice", "chunk").cogroup(laid.groupBy("slice", "chunk"))
             .applyInPandas(searcher(k), "query_id long, vec_id long, score long"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole(F.col("embedding")).alias("ints"))
    return top_k(vectors, F.col("vec_id") % EVERY == 0)


ORACLE = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as ints from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.ints::double[], c.ints::double[])::bigint as score
  from (select distinct vec_id, ints from v where vec_id % {EVERY} = 0) q join v c on q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= {TOP}"""
