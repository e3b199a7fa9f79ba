"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kd_topk, langid, minhash, packing, periodic, pii, pq_dedup, quality, token_store, toxicity, unigram, variants, windows

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": minhash.query,
        "op2_token_store": token_store.query,
        "op3_toxicity": toxicity.query,
        "op4_language_id": langid.query,
        "op5_embedding_near_dedup": pq_dedup.query,
        "op6_best_fit_packing": packing.query,
        "op7_exact_top_k": kd_topk.query,
        "op8_sentencepiece": unigram.query,
        "op9_quality_resampling": quality.query,
        "op10_pii": pii.query,
        "op11_concatenate_and_cut": windows.query,
        "op12_periodic_runs": periodic.query,
        "op13_spelling_variants": variants.query,
    }


def oracle_sql() -> dict[str, str]:
    """Token ids, trained models and samples have no SQL; tests compare those with brute force."""
    return {
        "op1_minhash_near_dedup": minhash.ORACLE_SQL,
        "op5_embedding_near_dedup": pq_dedup.ORACLE_SQL,
        "op7_exact_top_k": kd_topk.ORACLE_SQL,
        "op12_periodic_runs": periodic.ORACLE_SQL,
        "op13_spelling_variants": variants.ORACLE_SQL,
    }
