"""Queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from pulsegrid.llm import chat_format, decontam, license_scan, mixing, near_dedup, quality_cascade, secret_scan, token_counts, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        quality_cascade.op1_quality_rules,
        token_counts.op2_token_counts,
        chat_format.op3_chat_formatting,
        url_filter.op4_url_filters,
        mixing.op5_mixing,
        secret_scan.op6_secret_scans,
        near_dedup.op7_near_dedup,
        toxicity.op8_toxicity,
        decontam.op9_decontamination,
        license_scan.op10_license_scans,
    )
}
ORACLES = {
    "op1_quality_rules": quality_cascade.OP1_SQL,
    "op3_chat_formatting": chat_format.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_secret_scans": secret_scan.OP6_SQL,
    "op9_decontamination": decontam.OP9_SQL,
}
