"""The subpackage's queries and their SQL."""

from __future__ import annotations

from mnemora.llm import (
    chat_format, decontaminate, exact_dedup, language_id, license_scan, merkle, mixing, near_dedup, periodic_runs, quality, suffix_dedup,
    token_count, toxicity,
)

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_count": token_count.op3_token_count,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mix": mixing.op8_mix,
    "op9_language_id": language_id.op9_language_id,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op8_mix": mixing.ORACLE_SQL,
    "op10_near_dedup": near_dedup.ORACLE_SQL,
    "op11_license_scan": license_scan.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
