"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from fieldbook.llm import conversation_repair, decontaminate, language_id, licenses, line_dedup, media, mixing, near_dedup, pii, quality, quality_rules, source_divergence, substring_dedup

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_pii": pii.op3_pii,
    "op4_image_copies": media.op4_image_copies,
    "op5_mixing": mixing.op5_mixing,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_source_divergence": source_divergence.OP13_SQL,
}
