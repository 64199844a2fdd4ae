"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tarnhelm.llm import media, mixing, near_dedup, packing, passages, pseudo_likelihood, quality_rank, quality_rules, secrets, substring_dedup

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_media_columns": media.op2_media_columns,
    "op3_near_passages": passages.op3_near_passages,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_rank": quality_rank.op5_quality_rank,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_pseudo_likelihood": pseudo_likelihood.op7_pseudo_likelihood,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_pack_sequences": packing.op10_pack_sequences,
}

ORACLES = {
    "op6_source_mix": mixing.SQL,
}
