"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import (
    alignment,
    bpe,
    chat,
    exact_dedup,
    licenses,
    lmscore,
    mixing,
    neighbours,
    quality,
    runs,
    simhash,
    substrings,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_quality": quality.op4_quality,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_lm_score": lmscore.op8_lm_score,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_chat_format": chat.op12_chat_format,
    "op13_token_alignment": alignment.op13_token_alignment,
}

CHECKS: dict[str, str] = {"op10_exact_dedup": exact_dedup.OP10_SQL, "op12_chat_format": chat.OP12_SQL}
