"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

Documents longer than a bin are cut into full pieces and a rest. Open bins are held by their
residual; each carries one bitmap of the sources and one of the duplicate clusters in it. A
piece goes into the tightest bin that has neither its source nor its cluster: the search starts
at the residual equal to its length and goes on to the next larger one that is in use until a
compatible bin turns up, else a new bin is opened. Pieces come in order of decreasing length.

Best fit is sequential, so pieces are dealt by a hash of document, piece and number among its copies
to shards of about ``SHARD_PIECES`` pieces, each packed in one task from ids and lengths alone; a hot source or
cluster, or a document of many pieces, is dealt over all shards. The deal does not depend on how the input is
laid out in files. Bins never span shards.

Edge cases: tokens are runs other than ASCII white space; null and empty texts have none and get
no piece. A null source conflicts with nothing. Equal lengths go in order of id, then text hash, then piece, nulls
last. Rows repeated in full are pieces of one cluster, so they fall into different bins. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.llm.common import ship, stage, table

ship(__name__)

CAPACITY = 2048
SHARD_PIECES = 4096
_OUT = "bin_id string, slot int, doc_id {id}, piece int, first_token long, tokens long, source string"


def best_fit(sizes: list[int], sources: list[int | None], clusters: list[int], capacity: int) -> Iterator[int]:
    """The bin of each piece, in the given order.

    Bins of one residual stand under the bitmap of their sources, so that those which hold a
    piece's source are passed over together, the oldest first; ``used`` has a bit for every residual in use.
    """
    by_residual: dict[int, dict[int, list[int]]] = {}
    cluster_bits: list[int] = []
    used = 0
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit = 0 if source is None else 1 << source
        cluster_bit = 1 << cluster
        found, residual, ahead = None, size, used >> size
        while ahead and found is None:
            step = (ahead & -ahead).bit_length() - 1
            residual, ahead = residual + step, ahead >> step
            for held, bins in by_residual[residual].items():
                if not held & source_bit:
                    at = next((i for i, b in enumerate(bins) if not cluster_bits[b] & cluster_bit), None)
                    if at is not None and (found is None or bins[at] < found[2]):
                        found = (held, at, bins[at], residual)
            if found is None:
                residual, ahead = residual + 1, ahead >> 1
        if found is None:
            number, held, left = len(cluster_bits), 0, capacity
            cluster_bits.append(0)
        else:
            held, at, number, left = found
            bins = by_residual[left][held]
            bins.pop(at)
            if not bins:
                del by_residual[left][held]
                if not by_residual[left]:
                    del by_residual[left]
                    used &= ~(1 << left)
        cluster_bits[number] |= cluster_bit
        left -= size
        if left:
            insort(by_residual.setdefault(left, {}).setdefault(held | source_bit, []), number)
            used |= 1 << left
        yield number


def packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "row", "piece", "copy"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        number = lambda c: pd.factorize(pdf[c])[0].tolist()
        sources = [None if s < 0 else s for s in number("source")]
        pdf["bin"] = list(best_fit(pdf["tokens"].tolist(), sources, number("cluster"), capacity))
        pdf["slot"] = pdf.groupby("bin").cumcount().astype("int32")
        pdf["bin_id"] = pdf["shard"].astype(str) + "-" + pdf["bin"].astype(str)
        return pdf[["bin_id", "slot", "doc_id", "piece", "first_token", "tokens", "source"]]
    return pack


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, source, row, cluster (documents of equal text), copy, piece, first_token, tokens."""
    counted = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("row"), F.xxhash64(F.lower(F.trim("text"))).alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n")).where("n > 0")
    # rows repeated in full are told apart by their number
    each = counted.groupBy(*counted.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
    return cut.withColumn("first_token", F.col("piece") * F.lit(capacity).cast("long")).withColumn(
        "tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("first_token"))).drop("n")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: its bin, its place in it, the document and the tokens from first_token on."""
    cut = stage(pieces(docs, capacity))
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "copy", "piece"), F.lit(shards)))
    of_id = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(packer(capacity), _OUT.format(id=of_id))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
