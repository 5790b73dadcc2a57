"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    op1_jaccard_join,
    op2_language_id,
    op3_hamming,
    op4_tokens,
    op5_line_dedup,
    op6_quality,
    op7_substring_dedup,
    op8_mixing,
    op9_pii,
    op10_decontamination,
    op11_chat_format,
    op12_ranked_search,
)

MODULES = (op1_jaccard_join, op2_language_id, op3_hamming, op4_tokens, op5_line_dedup, op6_quality, op7_substring_dedup, op8_mixing, op9_pii, op10_decontamination, op11_chat_format, op12_ranked_search)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
