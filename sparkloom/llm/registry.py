"""The queries of this folder, by name."""

from __future__ import annotations

from sparkloom.llm import (
    exact_dedup,
    jaccard_join,
    language_id,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_packing": packing.query,
    "op2_mixing": mixing.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_quality_rules": quality_rules.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_secret_scan": secret_scan.query,
    "op7_toxicity": toxicity.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_language_id": language_id.query,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
}
