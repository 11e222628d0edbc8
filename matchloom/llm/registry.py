"""The queries of this subpackage, one for each operator, and their SQL."""

from matchloom.llm import (
    chunk_dedup,
    decontamination,
    language_model,
    mixing,
    near_dedup,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_chunk_dedup": chunk_dedup.op7_chunk_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_lm_scoring": language_model.op9_lm_scoring,
    "op10_decontamination": decontamination.op10_decontamination,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_decontamination": decontamination.SQL,
}
