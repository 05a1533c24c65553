"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this package with query(spark, sf_dir) and, perhaps, SQL.
MODULES = {
    "op8_toxicity": "toxicity",
    "op6_lm_scoring": "lm_score",
    "op7_suffix_array_dedup": "suffix_dedup",
    "op10_jaccard_join": "jaccard_join",
    "op1_decontamination": "decontaminate",
    "op3_html_extraction": "html_extract",
    "op5_language_id": "language_id",
    "op2_best_fit_packing": "packing",
    "op4_chat_formatting": "chat_format",
    "op9_quality_rules": "quality_rules",
}


def queries() -> dict:
    return {name: import_module(f".{m}", __package__).query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{m}", __package__), "SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
