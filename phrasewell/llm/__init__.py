"""Operators of a large-scale training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from phrasewell.llm import decontaminate, embedding_dedup, language_id, license_scan, lm_score, mixing, ngram_join, substring_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op10_lm_score": lm_score.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_toxicity": toxicity.query,
        "op4_decontaminate": decontaminate.query,
        "op5_ngram_join": ngram_join.query,
        "op6_mixing": mixing.query,
        "op7_language_id": language_id.query,
        "op8_token_counts": token_counts.query,
        "op9_substring_dedup": substring_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.sql(), "op2_embedding_dedup": embedding_dedup.SQL, "op4_decontaminate": decontaminate.SQL, "op6_mixing": mixing.SQL, "op9_substring_dedup": substring_dedup.SQL}
