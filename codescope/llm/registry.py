"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query: module
MODULES = {
    "op1_token_output": "token_output",
    "op2_mixing": "mixing",
    "op3_warc_bundles": "warc_bundles",
    "op4_language_id": "language_id",
    "op5_line_dedup": "line_dedup",
    "op6_ngram_join": "ngram_join",
    "op7_quality_classifier": "quality_classifier",
    "op8_personal_data": "personal_data",
    "op9_decontamination": "decontamination",
    "op10_quality_rules": "quality_rules",
    "op11_importance_resampling": "importance_resampling",
    "op12_simhash": "simhash",
    "op13_prefix_trie": "prefix_trie",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
