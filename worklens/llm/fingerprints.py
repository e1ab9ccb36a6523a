"""I-Match fingerprints over several randomised lexicons.

The lexicon is the band of terms that stand in ``BAND`` of all documents (a band of inverse
document frequency). The terms of a text that are in it are made distinct, sorted and hashed
once for each of ``SUBSETS`` random subsets of the lexicon; subsets keep all terms, half of them,
a quarter and so on, so that the share of equal hashes falls little by little as texts part.
The fingerprint is the row of hashes; a subset without a term of the text is left blank, and
a text without any lexicon term has the hash of all its terms instead.

Terms of the band are found in two passes over all documents without counting rare ones: a
term in at least a share of all documents is in at least that share of some chunk of them (Savasere,
Omiecinski and Navathe 1995). Each chunk puts forward its frequent terms, and the partitions that are too small
for a chunk form one together, so that many small partitions put forward no more than one large one. The second pass counts the terms put forward in full; they are broadcast if they are few, else joined by a shuffle. Only the lexicon comes to
the driver; its size is bounded by terms per document / least share.

Edge cases: a null text is empty; empty texts have equal fingerprints. The next document in
descending id is the one of the next smaller id; null ids come last, equal ids go by the
text's hash, and after the last comes the first (a single row follows itself). Repeated rows give
repeated results, an empty table an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import partitions, rows_of, ship, stage, table

ship(__name__)

BAND = (0.01, 0.2)
SUBSETS, TIERS = 40, 10
BLANK = "-"
#: Documents of a chunk, and of the smallest one that puts terms forward by itself (a term must then be in six).
CHUNK, LEAST_CHUNK = 2048, 512
#: Terms put forward that are sent to all tasks; more are joined by a shuffle.
SENT_TERMS = 200_000
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str) -> set[bytes]:
    return set(TERMS.findall(text.encode("utf-8", "surrogatepass").lower()))


def proposer(least: float):
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, n, rows): frequent terms of every chunk (n is null); of a partition too small for one all counts, and its rows once.

        The rows left over after a partition's last whole chunk belong to that chunk.
        """
        ready, ready_rows, df, rows, kept = Counter(), 0, Counter(), 0, set()

        def put(counts: Counter, of: int) -> None:
            kept.update(t for t, n in counts.items() if n >= least * of)

        for batch in batches:
            for text in batch.column(0):
                df.update(terms_of(text.as_py()))
                rows += 1
                if rows == CHUNK:
                    put(ready, ready_rows)
                    ready, ready_rows, df, rows = df, rows, Counter(), 0
        if ready_rows or rows >= LEAST_CHUNK:
            put(ready + df, ready_rows + rows)
            df, rows = Counter(), 0
        terms, counts = [*kept, *df, None], [*[None] * len(kept), *df.values(), None]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array([None] * (len(terms) - 1) + [rows], pa.int64())],
                                         names=["term", "n", "rows"])
    return propose


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of the documents of every batch."""
    for batch in batches:
        df = Counter()
        for text in batch.column(0):
            df.update(terms_of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[bytes]:
    """The sorted terms of the band, counted over all documents."""
    texts = docs.select(_text().alias("text"))
    rows = docs.count()
    # the partitions too small for a chunk are one together, counted by a shuffle
    put = stage(texts.mapInArrow(proposer(band[0]), "term binary, n long, rows long"))
    spare = put.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    candidates = put.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("whole")).where(
        F.col("whole") | (F.col("n") >= band[0] * spare)).select("term")
    candidates = stage(candidates)
    # so few that they fit every task keep the other terms' counts out of the shuffle
    side = F.broadcast(candidates) if candidates.count() <= SENT_TERMS else candidates
    df = (texts.mapInArrow(count_terms, "term binary, n long").join(side, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
          .where(F.col("df").between(band[0] * rows, band[1] * rows)).select("term").toPandas()["term"])
    return sorted(map(bytes, df))


class Printer:
    def __init__(self, terms: list[bytes]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], dtype=np.uint64)
        drawn = [np.array([xxhash.xxh3_64_intdigest(t, seed=k + 1) for t in terms], dtype=np.uint64) for k in range(SUBSETS)]
        self.subsets = np.array([d < np.uint64((1 << 64) - 1 >> k % TIERS) for k, d in enumerate(drawn)], dtype=bool).reshape(SUBSETS, len(terms))

    def fingerprint(self, text: str) -> list[str]:
        terms = terms_of(text)
        at = sorted(self.place[t] for t in terms if t in self.place)
        if not at:
            return [xxhash.xxh3_64_hexdigest(b" ".join(sorted(terms)))[:12]] + [BLANK] * (SUBSETS - 1)
        hashes, subsets = self.hashes[at], self.subsets[:, at]
        out = []
        for inside in subsets:
            picked = hashes[inside]
            out.append(xxhash.xxh3_64_hexdigest(picked.tobytes())[:12] if len(picked) else BLANK)
        return out


def likeness(x: list[str], y: list[str]) -> float:
    """Equal hashes among the subsets that either text has terms of."""
    used = [(a, b) for a, b in zip(x, y, strict=True) if a != BLANK or b != BLANK]
    return sum(a == b for a, b in used) / len(used)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _above(cuts: list[int], of: Column) -> Column:
    """How many cuts are larger: first among every step-th cut, then within that step."""
    step = max(1, int(len(cuts) ** 0.5))
    lit = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")
    size = lambda a: F.size(F.filter(a, lambda c: c > of))
    coarse = size(lit(cuts[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + size(F.slice(lit(cuts), (coarse - 1) * step + 1, step)))


def with_next(docs: DataFrame, each, schema: str) -> DataFrame:
    """Apply ``each(batches of (doc_id, text, own))`` to ranges of ids in descending order.

    A range is closed by the first document of the next one, marked as not its own. Range
    cuts come from approximate quantiles, which matter for balance only; whole texts are shuffled once.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    n = 4 * partitions(spark)
    cuts = keyed.select("doc_id").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_above(cuts, F.col("doc_id")) if cuts else F.lit(0)).cast("int")
    firsts = keyed.groupBy(part.alias("part")).agg(F.max("doc_id").alias("first")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], schema)
    first, lend = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, r in enumerate(firsts):  # the range before borrows this one's first document; the last borrows from the first
        first[r["part"]], lend[r["part"]] = r["first"], firsts[i - 1]["part"]
    lookup = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("part"))
    copies = F.when(F.col("doc_id").eqNullSafe(lookup(first, "bigint")), lookup(lend, "int"))
    lent = (keyed.withColumn("part", part).withColumn("to", F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("lent")),
            F.when(copies.isNotNull(), F.struct(copies.alias("part"), F.lit(1).alias("lent")))))).withColumn("to", F.explode("to")))
    return (lent.select("to.part", "to.lent", "doc_id", "text").repartition(n, "part")
            .sortWithinPartitions("part", "lent", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text").mapInArrow(each, schema))


def printer(terms):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Printer(terms.value)
        columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        held, out = None, []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)
        for batch in batches:
            for part, lent, doc_id, text in rows_of(batch):
                own = prints.fingerprint(text)
                if held is not None and held[0] == part and not held[1]:
                    _, _, before, whole, mark = held
                    half = len(whole) // 2
                    edited = whole[:len(whole) - half] + text[:half]
                    other = prints.fingerprint(edited)
                    out.append((before, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), ".".join(mark), ".".join(other),
                                likeness(mark, other), likeness(mark, own)))
                held = (part, lent, doc_id, text, own)
            if out:
                yield batch_of(out)
                out = []
    return fingerprints


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = spark.sparkContext.broadcast(lexicon(docs))
    return with_next(docs, printer(terms), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
