"""Exact ranked search of words, with posting lists blocked by the likeness of their documents.

Documents are tokenized once into a narrow table of the query terms they hold. Shards of that
table are searched by themselves: a shard keeps the impacts of its documents (a term's share of a
score) as a forward index, and the posting list of every query term. A list is cut into blocks
of similar documents (nearest of some of its documents, by a random projection of their impacts), and
a block stores the largest impact of every term in it.

A query goes through its terms' lists, the heaviest term first. A document of a later list that is
new has none of the earlier terms, so only the terms from there on can add to its score: a block is
skipped if its largest impacts of those terms, summed, stay below the k-th score so far, and the
search ends once the largest impacts of the whole shard do. A sum equal to the k-th score is
still searched, as a tie may have a smaller id. What is skipped cannot be among the first k, so
the result is exact. A list is cut into blocks when the first query gets to it. The k-th score goes
on from shard to shard of a task; the best of all shards are merged per query.

Queries are answered in chunks of bounded text, each by one pass over the documents.

Edge cases: a document without terms (null, empty, signs only) does not count; one with a null id counts in
the statistics but has no rank. Repeated rows are ranked row by row, and so are repeated items. An item without terms, or
without a document that holds one, has no rows; empty tables give none. Texts are read whole whatever their length.
Scores must fit in 64 bits. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window

from worklens.llm.common import rows_of, ship, stage, table, utf8
from worklens.llm.topk import best

ship(__name__)

TOP = 10
#: Documents and entries of a shard, documents of a block, width of the projection, bytes of the texts in a chunk of queries.
SHARD, SHARD_ENTRIES = 8_192, 2_000_000
BLOCK = 64
WIDTH = 16
CHUNK_BYTES = 1 << 20
#: Every byte that is no part of a term becomes a space; A-Z are lower-cased.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_FORWARD = "doc_id long, n long, terms array<int>, tf array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def forward(number: dict[bytes, int]):
    """(doc_id, n, numbers of the query terms it holds, their occurrences) of every document with a term."""
    wanted = number.keys()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, tf = [], [], [], []
            for doc_id, text in rows_of(batch):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    held = sorted((number[w], counts[w]) for w in counts.keys() & wanted)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append([t for t, _ in held])
                    tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                                             names=["doc_id", "n", "terms", "tf"])
    return tokenize


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """What every (document, term) adds to a score; ``n`` is given per entry."""
    m = 10 + (90 * n * documents) // occurrences
    return weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Forward index and blocked posting lists of some documents (ids, first entry of each, terms and impacts of the entries)."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.ids, self.starts, self.terms, self.impact, self.vocabulary = ids, starts, terms, impact, vocabulary
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.posting = row[order]
        self.list_start = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.list_start))
        if len(held):
            self.most[held] = np.maximum.reduceat(impact[order], self.list_start[held])
        self.lists, self._sketch = {}, None

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some documents, and where each document's begin (every document has one)."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        begin = np.cumsum(lengths) - lengths
        return np.repeat(self.starts[rows] - begin, lengths) + np.arange(lengths.sum()), begin

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at, begin = self.entries(rows)
        return np.add.reduceat(self.impact[at] * asked[self.terms[at]], begin)

    def sketch(self) -> np.ndarray:
        """A random projection of every document's impacts, of length one."""
        if self._sketch is None:
            signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(self.vocabulary, WIDTH))
            out = np.zeros((len(self.ids), WIDTH), dtype=np.float32)
            for at in range(0, len(self.ids), 1024):
                rows = np.arange(at, min(at + 1024, len(self.ids)))
                rows = rows[self.starts[rows + 1] > self.starts[rows]]
                if len(rows):
                    place, begin = self.entries(rows)
                    out[rows] = np.add.reduceat(signs[self.terms[place]] * self.impact[place, None].astype(np.float32), begin, axis=0)
            self._sketch = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self._sketch

    def blocks(self, term: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of a term's list: their documents; and where each summary begins, its terms, its largest impacts."""
        if term not in self.lists:
            rows = self.posting[self.list_start[term]:self.list_start[term + 1]]
            parts = self.similar(rows) if len(rows) > BLOCK else [rows]
            block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            joined = np.concatenate(parts)
            at, _ = self.entries(joined)
            key = np.repeat(block, self.starts[joined + 1] - self.starts[joined]) * self.vocabulary + self.terms[at]
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            highest, key = np.maximum.reduceat(self.impact[at][order], first), key[order][first]
            self.lists[term] = parts, np.searchsorted(key // self.vocabulary, np.arange(len(parts))), key % self.vocabulary, highest
        return self.lists[term]

    def similar(self, rows: np.ndarray) -> list[np.ndarray]:
        """The documents of a list by the nearest of evenly drawn ones among them; large groups are cut."""
        sketch = self.sketch()[rows]
        drawn = np.random.default_rng(len(rows)).choice(len(rows), size=-(-len(rows) // BLOCK), replace=False)
        nearest = np.concatenate([(sketch[i:i + 4096] @ sketch[drawn].T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        order = np.argsort(nearest, kind="stable")
        groups = np.split(rows[order], np.flatnonzero(np.diff(nearest[order])) + 1)
        return [g[i:i + 2 * BLOCK] for g in groups for i in range(0, len(g), 2 * BLOCK)]

    def search(self, terms: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The first k (scores, ids) of ``top`` and this shard, and how many documents were scored.

        ``terms`` are the query's, heaviest first.
        """
        asked, seen, scored = np.zeros(self.vocabulary, dtype=np.int64), np.zeros(len(self.ids), dtype=bool), 0
        asked[terms] = 1
        left = asked.copy()
        for turn, term in enumerate(terms):
            floor = top[0][-1] if len(top[0]) == k else 1
            if self.most[terms[turn:]].sum() < floor:
                break
            if self.list_start[term] < self.list_start[term + 1]:
                parts, begin, summary, highest = self.blocks(term)
                bounds = np.add.reduceat(highest * left[summary], begin)
                for block in np.argsort(-bounds, kind="stable"):
                    if bounds[block] < (top[0][-1] if len(top[0]) == k else 1):
                        break
                    rows = parts[block][~seen[parts[block]]]
                    if len(rows):
                        seen[rows] = True
                        found = self.scores(rows, asked)
                        scored += len(rows)
                        keep = found >= (top[0][-1] if len(top[0]) == k else 1)
                        if keep.any():
                            top = best(np.concatenate([top[0], found[keep]]), np.concatenate([top[1], self.ids[rows[keep]]]), k)
            left[term] = 0
        return top, scored


def searcher(weight: np.ndarray, queries: list[tuple[int, np.ndarray]], documents: int, occurrences: int, k: int, shard: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        tops = {item: (none, none) for item, _ in queries}
        held, entries = [], 0

        def close() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, n = whole["doc_id"].to_numpy(), whole["n"].to_numpy()
            lengths = whole["terms"].combine_chunks().value_lengths().to_numpy()
            flat = [whole[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tf")]
            terms = flat[0].astype(np.int64)
            impact = impacts(weight, terms, flat[1].astype(np.int64), np.repeat(n, lengths), documents, occurrences)
            made = Shard(ids, np.concatenate([[0], np.cumsum(lengths)]), terms, impact, len(weight))
            for item, asked in queries:
                tops[item], _ = made.search(asked, tops[item], k)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                entries += len(part.column("terms").flatten())
                if sum(b.num_rows for b in held) >= shard or entries >= SHARD_ENTRIES:
                    close()
                    held, entries = [], 0
        if held:
            close()
        rows = [(item, int(d), int(s)) for item, (scores, ids) in tops.items() for s, d in zip(scores, ids, strict=True)]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])
    return search


def chunks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """The items as (number, id, distinct terms), so many at a time that their texts stay below a limit (or one)."""
    chunk, size = [], 0
    for number, (item_id, text) in enumerate(items.select("item_id", utf8("text")).toLocalIterator()):
        if chunk and size + len(text) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append((number, item_id, sorted(set(terms_of(bytes(text))))))
        size += len(text)
    if chunk:
        yield chunk


def rank_chunk(docs: DataFrame, chunk: list[tuple[int, object, list[bytes]]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items of a chunk, by their numbers."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, _, terms in chunk for t in terms}))}
    rows = stage(docs.select(F.col("doc_id").cast("long"), utf8("text")).mapInArrow(forward(number), _FORWARD))
    facts = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    df = {r["term"]: r["n"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weight = np.array([term_weight(facts["documents"], df.get(i, 0)) for i in range(len(number))], dtype=np.int64)
    # a term that no document holds adds nothing
    asked = [(item, np.array(sorted((number[t] for t in terms if number[t] in df), key=lambda i: (-weight[i], i)), dtype=np.int64)) for item, _, terms in chunk]
    some = rows.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "tf")
    found = some.mapInArrow(searcher(weight, asked, facts["documents"], facts["occurrences"], k, SHARD), "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text)."""
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType
    for chunk in chunks(items, CHUNK_BYTES):
        names = spark.createDataFrame([(n, i) for n, i, _ in chunk], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        part = rank_chunk(docs, chunk, k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])) if out is None else out


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
with words as (select doc_id, row_number() over () as r, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as terms from documents where text is not null),
d as (select doc_id, r, terms, len(terms) as n from words where len(terms) > 0),
facts as (select count(*) as docs, sum(n)::bigint as occurrences from d),
tf as (select doc_id, r, n, term, count(*) as tf from (select doc_id, r, n, unnest(terms) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, facts group by term),
q as (select item_id, row_number() over () as i, list_distinct(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) as terms from benchmark where text is not null),
asked as (select item_id, i, unnest(terms) as term from q),
scored as (select item_id, i, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // occurrences)))))::bigint as score
  from asked join tf using (term) join w using (term), facts group by all)
select item_id, row_number() over (partition by i order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 and doc_id is not null qualify row_number() over (partition by i order by score desc, doc_id) <= {TOP}"""
