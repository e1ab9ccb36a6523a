"""Documents to packed training sequences: every stage reads what its predecessor kept as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from worklens.llm import language_id, mixing, near_dedup, packing, secrets
from worklens.storage import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language stay."""
    return language_id.keep_identified(spark, docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one_each(docs)


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.repeat_to_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the sequence length."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", dedup), ("secrets", scrub), ("mixing", mix), ("packing", pack)]

#: Language ID is a trained model, which SQL cannot express; tests hold every stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/worklens/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
