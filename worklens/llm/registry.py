"""The registered queries of this subpackage and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from worklens.llm import (
    chat_format, fingerprints, language_id, lexical_search, licenses, mixing, near_dedup, packing, secrets, token_alignment, token_counts, topk, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    named = [
        licenses.op1_license_scan, near_dedup.op2_minhash_near_dedup, fingerprints.op3_document_fingerprints, mixing.op4_source_mixing,
        chat_format.op5_chat_formatting, warc.op6_warc_revisits, topk.op7_exact_top_k, secrets.op8_secret_scan,
        packing.op9_best_fit_packing, language_id.op10_language_id, token_alignment.op11_cross_tokenizer_alignment,
        token_counts.op12_token_counts, lexical_search.op13_ranked_lexical_search]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": mixing.ORACLE, "op6_warc_revisits": warc.ORACLE, "op7_exact_top_k": topk.ORACLE, "op8_secret_scan": secrets.ORACLE,
            "op13_ranked_lexical_search": lexical_search.ORACLE}
