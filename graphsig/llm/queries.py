"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from graphsig.llm import (
    chat_format,
    conversation_repair,
    decontaminate,
    language_id,
    line_dedup,
    packing,
    personal_data,
    quality_rules,
    secret_scan,
    simhash_dedup,
    site_style,
    token_alignment,
    url_filter,
)

QUERIES = {
    "op1_quality_rules": quality_rules.quality_rules,
    "op2_html_extraction": site_style.html_extraction,
    "op3_url_filters": url_filter.url_filters,
    "op4_benchmark_decontamination": decontaminate.benchmark_decontamination,
    "op5_line_dedup": line_dedup.line_dedup,
    "op6_secret_scans": secret_scan.secret_scans,
    "op7_chat_formatting": chat_format.chat_formatting,
    "op8_language_id": language_id.language_id,
    "op9_best_fit_packing": packing.best_fit_packing,
    "op10_simhash_near_dedup": simhash_dedup.simhash_near_dedup,
    "op11_personal_data": personal_data.personal_data,
    "op12_cross_tokenizer_alignment": token_alignment.cross_tokenizer_alignment,
    "op13_conversation_repair": conversation_repair.conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_chat_formatting": chat_format.ORACLE,
}
