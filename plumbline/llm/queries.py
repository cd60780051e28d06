"""The operators' queries and their SQL, for __spark_entry__."""

from __future__ import annotations

import importlib

_OPERATORS = {
    "op1_url_filter": "urls",
    "op2_suffix_dedup": "suffix",
    "op3_neighbours": "ann",
    "op4_near_duplicates": "neardup",
    "op5_packing": "packing",
    "op6_language_id": "langid",
    "op7_warc": "warc",
    "op8_bpe": "bpe",
    "op9_sharding": "sharding",
    "op10_quality": "quality",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"{__package__}.{module}") for name, module in _OPERATORS.items()}
    return {name: m.SQL for name, m in modules.items() if hasattr(m, "SQL")}
