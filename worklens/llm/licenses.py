"""Licence scan with a positional index of rare licence words.

The index holds, for each word of the templates, its postings (template, position). Every
licence word of a document is weighed by its inverse document frequency over the whole table.
Of a template two words are looked up: its rarest and its next rarest in this corpus. Where
both stand in a document at the distance that the postings give, the template may start there;
its mandatory phrase, word by word, must then follow at its place. As both words are part of
that phrase, no place of it is lost.

A verified place is scored by the weight of the template's words that stand at their places
(the phrase and the optional words before it), from 0 to 1. Base templates have the phrase
alone, so any place of one scores 1; the document's score is its best.

Words are runs of ASCII digits, letters (A-Z lower-cased) and signs outside ASCII.

Edge cases: a null text is empty; without words every count is 0, the words' places are null
and the labels empty. Repeated rows give repeated results, null ids are carried along, an empty
table gives an empty result. Other columns are not read. Whole texts are read whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from worklens.llm.common import ship, table, utf8

ship(__name__)

# Fixed values: (label, optional words before the phrase, mandatory phrase); the first three are the base.
TEMPLATES = (
    ("mit", "", "under the mit license"),
    ("apache-2", "", "apache license version 2"),
    ("cc-by-nc", "", "cc by nc"),
    ("gpl-3", "this work is licensed under the", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the", "gnu general public license version 2"),
    ("lgpl-3", "this work is licensed under the", "gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the", "gnu affero general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person", "obtaining a copy of this software"),
    ("bsd", "", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the", "mozilla public license v 2 0"),
    ("cc-by", "licensed under a", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under", "cc by sa"),
    ("cc0", "", "cc0 1 0 universal"),
)
BASE = 3
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


def vocabulary() -> set[bytes]:
    return {w for _, before, phrase in TEMPLATES for w in words_of(f"{before} {phrase}".encode())}


class Index:
    """Per template: all its words, where its phrase starts, the two words to look up and their places."""

    def __init__(self, idf: dict[bytes, float]):
        self.entries, self.first = [], {}
        for number, (label, before, phrase) in enumerate(TEMPLATES):
            lead, core = words_of(before.encode()), words_of(phrase.encode())
            places = sorted(range(len(core)), key=lambda i: (-idf[core[i]], i))
            rare, next_rare = places[0], places[1]
            weights = [idf[w] for w in lead + core]
            self.entries.append((label, lead + core, len(lead), rare, next_rare, weights))
            self.first.setdefault(core[rare], []).append(number)
        self.rarest = frozenset(self.first)

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its phrase, score) of every verified place."""
        found = []
        for at, word in enumerate(words):
            for number in self.first.get(word, ()):
                _, whole, lead, rare, next_rare, weights = self.entries[number]
                start, core = at - rare, whole[lead:]
                if start < 0 or start + len(core) > len(words) or words[start + next_rare] != core[next_rare]:
                    continue
                if words[start:start + len(core)] == core:
                    met = sum(w for i, w in enumerate(weights) if start - lead + i >= 0 and words[start - lead + i] == whole[i])
                    found.append((number, start, met / sum(weights)))
        return found


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and licence word: the documents that hold it."""
    known, df, rows = vocabulary(), Counter(), 0
    for batch in batches:
        rows += batch.num_rows
        for text in batch.column(0):
            df.update(known.intersection(words_of(text.as_py())))
    df[b""] = rows
    yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in df]), pa.array(list(df.values()), pa.int64())], names=["word", "df"])


def inverse_frequencies(docs: DataFrame) -> dict[bytes, float]:
    """Over all documents; only the templates' words come to the driver."""
    rows = (docs.select(utf8("text").alias("bytes")).mapInArrow(frequencies, "word string, df long")
            .groupBy("word").agg(F.sum("df").alias("df")).collect())
    df = {r["word"].encode(): r["df"] for r in rows}
    return {w: math.log((df.get(b"", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}


def scanner(idf: dict[bytes, float]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf)
        for batch in batches:
            out = {k: [] for k in ("n_words", "starts", "templates", "scores")}
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = [] if index.rarest.isdisjoint(words) else index.places(words)
                out["n_words"].append(len(words))
                out["templates"].append([f[0] for f in found])
                out["starts"].append([f[1] for f in found])
                out["scores"].append([f[2] for f in found])
            kinds = {"n_words": pa.int64(), "starts": pa.list_(pa.int64()), "templates": pa.list_(pa.int32()), "scores": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], t) for k, t in kinds.items()]], names=["doc_id", *kinds])
    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the verified places: arrays of starts, templates (numbers in TEMPLATES) and scores."""
    of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("bytes")).mapInArrow(
        scanner(inverse_frequencies(docs)), f"doc_id {of_id}, n_words long, starts array<long>, templates array<int>, scores array<double>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    base = F.transform(F.filter(F.arrays_zip("starts", "templates"), lambda x: x["templates"] < BASE), lambda x: x["starts"])
    labels = lambda keep: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.filter("templates", keep), lambda t: F.get(names, t)))))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        labels(lambda t: t < BASE).alias("base_labels"), labels(lambda t: t >= 0).alias("labels"),
        F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("score"))
