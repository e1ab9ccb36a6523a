"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the whole lower-cased text, with
runs of other ASCII signs standing as blanks. Document frequencies cover every training row.
The weights are fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties on a bounded sample (``sample_rows``, split evenly over the languages), a fifth of
which is kept apart to set the temperature of the probabilities.

Edge cases: a null text, or one without any letter, is ``und`` with score 0. Rows without a
label, text or id never train. Copies of a labelled text train once. Without any labelled row
there is nothing to learn and every text is ``und``. An empty table gives an empty result.
Other columns are neither read nor returned by ``identify``; equal texts get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import ship, table

ship(__name__)

BITS = 15
GRAMS = (1, 2, 3)
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that the weights are fitted on; everything else is read
    whole. All labels are learnt: a table with more than ``max_languages`` of them is refused, as
    the weights grow with their number."""

    sample_rows: int = 2400
    max_languages: int = 1024
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the text and how often each stands in it."""
    signs = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (signs < 128) & ~((signs >= 97) & (signs <= 122))
    signs = np.where(blank, np.uint32(32), signs)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, len(signs), PIECE):
        part = signs[at:at + PIECE + GRAMS[-1] - 1]
        mixed = np.zeros(len(part), dtype=np.uint32)
        for n in GRAMS:
            width = min(len(part) - n + 1, PIECE)
            if width <= 0:
                break
            mixed = (mixed[:width] ^ part[n - 1:n - 1 + width]) * np.uint32(2654435761)
            hashed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
            counts += np.bincount(hashed >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, s: Settings):
    """FTRL-proximal over the rows in their order; the last coordinate is the bias."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def leader(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(ns)) / s.alpha + s.l2)
        return np.where(np.abs(zs) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for at, x, label in rows:
            at, x = np.append(at, size), np.append(x, 1.0)
            w = leader(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = leader(np.arange(size + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden-section search."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def trainable(doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1) & F.col(text).isNotNull() & F.col(lang).isNotNull()


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            at, _ = gram_counts(text.as_py())
            df[at] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["gram", "df"])


def sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams, counts = [], []
        for text in batch.column(2):
            at, c = gram_counts(text.as_py())
            grams.append(at.astype("<u2").tobytes())
            counts.append(c.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())],
                                         names=["lang", "draw", "grams", "counts"])


def fit(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """Learn from the rows that ``trainable`` keeps; None if there are none."""
    rows = docs.where(trainable()).select("text", "lang", F.pmod(F.xxhash64("text", "lang", "doc_id"), F.lit(1 << 30)).alias("draw"))
    sizes = (rows.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(s.max_languages + 1).collect())
    if not sizes:
        return None
    if len(sizes) > s.max_languages:
        raise ValueError(f"more than {s.max_languages} languages are labelled")
    languages = sorted(r["lang"] for r in sizes)
    total = sum(r["n"] for r in sizes)
    idf = np.full(1 << BITS, np.log(total + 1.0) + 1.0)
    found = (rows.select("text").mapInArrow(document_frequencies, "gram long, df long")
             .groupBy("gram").agg(F.sum("df").alias("df")).toPandas())
    idf[found["gram"]] = np.log((total + 1.0) / (found["df"] + 1.0)) + 1.0
    share = max(1, s.sample_rows // len(languages))
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, share / r["n"]) * (1 << 30)))])
    sample = (rows.where(F.col("draw") < cut[F.col("lang")]).groupBy("text", "lang").agg(F.min("draw").alias("draw"))
              .select("lang", "draw", "text").mapInArrow(sparse_rows, "lang string, draw long, grams binary, counts binary"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "lang"])
        data = []
        for lang, grams, counts in zip(pdf["lang"], pdf["grams"], pdf["counts"], strict=True):
            at = np.frombuffer(grams, dtype="<u2").astype(np.int64)
            data.append((at, weighted(at, np.frombuffer(counts, dtype="<f4"), idf), languages.index(lang)))
        apart = data[::5] if len(data) >= 50 else data
        kept = [d for i, d in enumerate(data) if i % 5] if len(data) >= 50 else data
        w, b = follow_the_leader(kept, 1 << BITS, len(languages), s)
        logits = np.array([x @ w[at] + b for at, x, _ in apart])
        t = best_temperature(logits, np.array([d[2] for d in apart])) if len(languages) > 1 else 1.0
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "b": [b.astype("<f8").tobytes()], "t": [t]})

    fitted = sample.groupBy().applyInPandas(train, "w binary, b binary, t double").first()
    if fitted is None:
        return None
    weights = np.frombuffer(fitted["w"], dtype="<f4").reshape(1 << BITS, len(languages))
    return Model(languages, idf, weights, np.frombuffer(fitted["b"], dtype="<f8"), fitted["t"])


def predictor(spark: SparkSession, model: Model | None):
    """An Arrow function from texts to (lang_pred, score)."""
    # plain values: executors need not have this module to read them
    held = spark.sparkContext.broadcast(None if model is None else (model.languages, model.idf, model.weights, model.bias, model.temperature))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m = held.value
        langs, scores = [], []
        for text in texts:
            text = text.as_py()
            if not text or m is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, counts = gram_counts(text)
            languages, idf, weights, bias, temperature = m
            p = softmax((weighted(at, counts, idf) @ weights[at] + bias) / temperature)
            best = int(p.argmax())
            langs.append(languages[best])
            scores.append(float(p[best]))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def lettered(text: str = "text") -> Column:
    """The text if it has a letter, else null."""
    return F.when(F.col(text).rlike(r"\p{L}"), F.col(text))


def identify(docs: DataFrame, model: Model | None, keep: list[str | Column]) -> DataFrame:
    """The kept columns with lang_pred and score."""
    predict = predictor(docs.sparkSession, model)
    return docs.select(*keep, predict(lettered()).alias("__answer")).select("*", "__answer.*").drop("__answer")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs, fit(docs), ["doc_id", held.alias("held_out")])


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Pipeline stage: documents whose language is recognised with at least that score; `und` goes."""
    predict = predictor(spark, fit(docs))
    return docs.where(predict(lettered())["score"] >= least)
