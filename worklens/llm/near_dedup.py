"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the distinct five-word shingles of its whole text, each under one
64-bit hash. The ``SKETCH`` smallest hashes are its bottom-k sketch. Equal sets are one node,
so copies never meet each other. Inverted lists of retained values bring overlapping nodes
together. Pairs whose union sketch estimates a similarity under ``FLOOR`` are dropped, the
others are confirmed on full sets.

Values that more than ``LIST`` nodes retain (passages, boiler-plate, large groups) head no list
of sketches. Nodes whose sketch consists of them to a third are a crowd: their full sets are
listed instead, under as many first values as sets of the least similarity must share one of,
values rare in the crowd before common ones. Two nodes that meet at a common value, but at no rare one,
differ in all their rare members, which rules most pairs of a crowd out by two counts.

No list is expanded into all pairs while it may hold one group: for ``ROUNDS`` rounds every
list compares its members with one pivot (at first the one with the fewest rare members), and
only members of different groups so far. Lists that still hold several groups then compare
the members of different groups with one another, in full and whatever their length: nothing
is capped. Outside crowds a pair at the threshold escapes only if no shared shingle is among
the first two dozen rare values (odds near 0.15^24 at 85 percent, 0.2^24 at 80), anywhere only
if the estimate is off by seven deviations (six at 80 percent).

``op2_minhash_near_dedup`` links at 85 percent, as its contract says; the pipeline's stage at 80.

Edge cases: null and empty texts (no word) have an empty set and are linked with nothing. Under
five words the whole sequence is the one shingle. Rows of equal sets are one group whatever
their id; a null id counts as larger than any other. Repeated rows stay repeated in the result;
an empty table gives an empty one. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.llm.common import components, few, rows_of, ship, stage, table, utf8

ship(__name__)

SHINGLE = 5
SKETCH = 48
RARE, LIST, CROWD, CROWD_LIST = 24, 8, 3, 40
MOST_COMMON = 200_000
FLOOR = 0.45
ROUNDS, PIVOTS = 2, 3
_CROWD = np.int64(0x5851F42D4C957F2D)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    mixed = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for at in range(width):
        mixed = (mixed ^ h[at:at + len(mixed)]) * _PRIME
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, sketch = [], [], []
        for text in batch.column(3):
            values = shingle_hashes(text.as_py())
            sizes.append(len(values))
            nodes.append(xxhash.xxh3_128_digest(values.tobytes()))
            sketch.append(values[:SKETCH])
        flat = np.concatenate(sketch) if sketch else np.zeros(0, dtype=np.int64)
        ends = np.cumsum([0, *map(len, sketch)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()),
             pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "row", "idh", "n", "node", "sketch"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingle_hashes(t.as_py()).tobytes() for t in batch.column(1)], pa.binary()), batch.column(2)],
            names=["node", "members", "crowd"])


def estimated(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity as the share of common values among the smallest of the union."""
    union = np.union1d(x, y)[:SKETCH]
    return np.isin(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True).sum() / len(union)


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        keep = [estimated(np.asarray(x[i].values), np.asarray(y[i].values)) >= FLOOR for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, x, y in rows_of(batch, 64):
                x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return confirm


def lister(common: np.ndarray):
    """Emits (value, node, n) for the rare retained values of each node, and without a value for each node of a crowd."""
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = [], []
            for i in range(batch.num_rows):
                v = np.asarray(batch.column(2)[i].values)
                often = np.isin(v, common, assume_unique=True)
                picked = v[~often][:RARE].tolist()
                picked += [None] * (CROWD * int(often.sum()) >= len(v))
                values += picked
                sizes.append(len(picked))
            at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["value", "node", "n"])
    return lists


def all_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(members.as_py(), dtype=np.int64))], names=["value"])


def prefix_lister(common: np.ndarray, percent: int):
    """Emits (value, node, n, r, often) for the first values of each set, rare ones before common ones.

    Sets of which at most ``100 - percent`` of a hundred members may differ share one of so many
    first values under any one order. ``r`` is how many rare members the set has.
    """
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, many, ns, rs, oftens = [], [], [], [], []
            for members in batch.column(1):
                v = np.frombuffer(members.as_py(), dtype=np.int64)
                often = np.isin(v, common, assume_unique=True)
                first = len(v) - -(-percent * len(v) // 100) + 1
                rare, shared = v[~often], v[often]
                picked = [rare[:first], shared[:max(0, first - len(rare))]]
                values += picked
                many.append(len(picked[0]) + len(picked[1]))
                oftens.append(np.repeat([False, True], [len(picked[0]), len(picked[1])]))
                ns.append(len(v))
                rs.append(len(rare))
            flat = np.concatenate(values) ^ _CROWD if values else np.zeros(0, dtype=np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), many))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, pa.int64()), batch.column(0).take(at), pa.array(ns, pa.int64()).take(at), pa.array(rs, pa.int64()).take(at),
                 pa.array(np.concatenate(oftens) if oftens else np.zeros(0, dtype=bool), pa.bool_())], names=["value", "node", "n", "r", "often"])
    return lists


def most_common(values: DataFrame, rows: int) -> np.ndarray:
    """The values that more than so many rows have, at most ``MOST_COMMON`` of them; which ones only matters for speed."""
    found = (values.groupBy("value").count().where(F.col("count") > rows).orderBy(F.desc("count"), "value").limit(MOST_COMMON).select("value").toPandas())
    return np.sort(found["value"].to_numpy(dtype=np.int64))


def shared_lists(postings: DataFrame) -> DataFrame:
    return postings.join(postings.groupBy("value").count().where("count > 1").select("value"), "value")


def links(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """The groups (node, root) that confirmed links make; None without any link.

    ``nodes`` has node, row, idh, n and sketch, one row each; ``docs`` the bytes under row and idh.
    """
    common = most_common(nodes.select(F.explode("sketch").alias("value")), LIST)
    postings = stage(nodes.select("node", "n", "sketch").mapInArrow(lister(common), "value long, node binary, n long"))
    rare = stage(shared_lists(postings.where("value is not null")))
    crowd = postings.where("value is null").select("node", F.lit(True).alias("crowd"))
    met = rare.select("node", F.lit(False).alias("crowd")).union(crowd).groupBy("node").agg(F.max("crowd").alias("crowd"))
    heads = nodes.join(met, "node").select("node", "row", "idh", "crowd")
    sets = stage(docs.join(heads, ["row", "idh"]).dropDuplicates(["row", "idh"]).select("node", "bytes", "crowd")
                 .mapInArrow(full_sets, "node binary, members binary, crowd boolean"))
    crowded = sets.where("crowd").select("node", "members")
    again = most_common(crowded.select("members").mapInArrow(all_values, "value long"), CROWD_LIST)
    dense = stage(crowded.mapInArrow(prefix_lister(again, percent), "value long, node binary, n long, r long, often boolean"))
    lists = stage(rare.select("value", "node", "n", F.lit(0).cast("long").alias("r"), F.lit(False).alias("often")).union(shared_lists(dense).select(dense.columns)))
    sketch = stage(nodes.select("node", "sketch").join(lists.select("node").distinct(), "node", "left_semi"))

    # lists: those that still hold several groups, each member with the root of its group
    lists, found, tested, groups = lists.withColumn("root", F.col("node")), None, None, None
    # sets that meet at a common value and share no rare one differ in all their rare members, and by their sizes
    apart = F.greatest(F.col("r"), F.col("r2") + F.col("n") - F.col("m")) + F.greatest(F.col("r2"), F.col("r") + F.col("m") - F.col("n"))
    similar = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (
        ~F.col("often") | ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            drawn = F.struct((F.col("r") if turn == 0 else F.lit(0)).alias("first"), F.xxhash64("node", F.pmod("value", F.lit(PIVOTS)), F.lit(turn)).alias("h"), "node", "n", "r", "root")
            pivots = lists.groupBy("value").agg(F.min(drawn).alias("p"))
            met = lists.join(pivots, "value").where("root <> p.root").select(
                "node", "n", "r", "often", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.r").alias("r2")).where(similar)
        else:
            other = lists.select("value", F.col("node").alias("other"), F.col("n").alias("m"), F.col("r").alias("r2"), F.col("root").alias("root2"))
            met = lists.join(other, (lists["value"] == other["value"]) & (F.col("root") < F.col("root2")) & similar)
        pairs = few(few(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct())
        pairs = stage(pairs if tested is None else few(pairs.join(tested, ["a", "b"], "left_anti")))
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        side = lambda t, c, as_: t.select(F.col("node").alias(c), F.col(t.columns[1]).alias(as_))
        near = stage(few(few(pairs.join(side(sketch, "a", "x"), "a")).join(side(sketch, "b", "y"), "b")
                         .select("a", "b", "x", "y").mapInArrow(likely, "a binary, b binary")))
        sure = stage(few(few(near.join(side(sets, "a", "x"), "a")).join(side(sets, "b", "y"), "b")
                         .select("a", "b", "x", "y").mapInArrow(confirmer(percent), "a binary, b binary")))
        if sure.isEmpty():
            continue
        found = sure if found is None else found.union(sure)
        groups = components(found)
        if turn < ROUNDS:
            named = stage(few(lists.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))))
            split = named.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("value")
            lists = stage(few(named.join(split, "value")))
    return groups


def identified(docs: DataFrame) -> DataFrame:
    """The documents with the hashes of text and id that name a row; repeated rows share theirs."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.xxhash64("doc_id").alias("idh"), utf8("text").alias("bytes"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and component, row, idh.

    ``percent`` is the least similarity. ``component`` names the group also where no member has
    an id; a document without words is a group of its own.
    """
    source = identified(docs)
    of_id = docs.schema["doc_id"].dataType.simpleString()
    drawn = stage(source.mapInArrow(sketches, f"doc_id {of_id}, row long, idh long, n long, node binary, sketch array<long>"))
    full, empty = drawn.where("n > 0"), drawn.where("n = 0")
    nodes = stage(full.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "idh")).alias("head"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        .select("node", "head.doc_id", "head.row", "head.idh", "n", "sketch"))
    groups = links(nodes, source, percent)
    joined = nodes.select("node", "doc_id") if groups is None else nodes.select("node", "doc_id").join(groups, "node", "left")
    root = F.col("node") if groups is None else F.coalesce("root", "node")
    joined = stage(joined.withColumn("component", F.hex(root)))
    lowest = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(joined.select("node", "component").join(lowest, "component"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "row", "idh"]
    alone = empty.withColumn("component_id", F.col("doc_id")).withColumn("component", F.concat_ws(":", F.lit("empty"), "row", "idh"))
    return full.join(named, "node").select(*columns).union(alone.select(*columns))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("component", "row", "idh")


def keep_one_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id (ties: the smallest text hash) stays, once."""
    decided = near_duplicates(docs.select("doc_id", "text"), percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "idh")).alias("first")
    winners = decided.groupBy("component").agg(first).select(F.col("first.row").alias("__row"), F.col("first.idh").alias("__idh"))
    return (docs.withColumn("__row", F.xxhash64("text")).withColumn("__idh", F.xxhash64("doc_id"))
            .join(winners, ["__row", "__idh"], "left_semi").dropDuplicates(["__row", "__idh"]).select(*docs.columns))
