"""The queries of this subpackage and their SQL for the driver."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage.
MODULES = {
    "op1_token_files": "op01_token_files",
    "op2_source_mix": "op02_source_mix",
    "op3_substring_dedup": "op03_substring_dedup",
    "op4_jaccard_join": "op04_jaccard_join",
    "op5_url_filter": "op05_url_filter",
    "op6_quality_rules": "op06_quality_rules",
    "op7_byte_bpe": "op07_byte_bpe",
    "op8_exact_dedup": "op08_exact_dedup",
    "op9_token_counts": "op09_token_counts",
    "op10_license_scan": "op10_license_scan",
}


def queries() -> dict:
    return {name: importlib.import_module(f"pagemill.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"pagemill.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
