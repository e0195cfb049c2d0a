"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import (
    queries_exact_dedup,
    queries_language_id,
    queries_license_scan,
    queries_minhash_join,
    queries_mixing,
    queries_ngram_join,
    queries_packing,
    queries_periodic_runs,
    queries_spelling_variants,
    queries_token_counts,
    queries_topk,
    queries_toxicity,
    queries_warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": queries_language_id.op1_language_id,
        "op2_mix_sources": queries_mixing.op2_mix_sources,
        "op3_toxicity": queries_toxicity.op3_toxicity,
        "op4_pack_documents": queries_packing.op4_pack_documents,
        "op5_ngram_join": queries_ngram_join.op5_ngram_join,
        "op6_top_k": queries_topk.op6_top_k,
        "op7_license_scan": queries_license_scan.op7_license_scan,
        "op8_token_counts": queries_token_counts.op8_token_counts,
        "op9_exact_dedup": queries_exact_dedup.op9_exact_dedup,
        "op10_warc": queries_warc.op10_warc,
        "op11_minhash_join": queries_minhash_join.op11_minhash_join,
        "op12_spelling_variants": queries_spelling_variants.op12_spelling_variants,
        "op13_periodic_runs": queries_periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_top_k": queries_topk.SQL,
        "op7_license_scan": queries_license_scan.SQL,
        "op9_exact_dedup": queries_exact_dedup.SQL,
    }
