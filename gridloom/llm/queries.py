"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name: (module, SQL constant or None).
_QUERIES = {
    "op1_secrets": ("secrets", None),
    "op2_substring_dedup": ("substring_dedup", "OP2_SQL"),
    "op3_token_counts": ("token_counts", None),
    "op4_best_fit_packing": ("packing", None),
    "op5_near_dedup": ("near_dedup", "OP5_SQL"),
    "op6_toxicity": ("toxicity", None),
    "op7_quality": ("quality", None),
    "op8_pii_surrogates": ("pii", None),
    "op9_decontaminate": ("decontaminate", "OP9_SQL"),
    "op10_language_id": ("language_id", None),
    "op11_filter_audit": ("filter_audit", "OP11_SQL"),
    "op12_importance_resampling": ("resampling", "OP12_SQL"),
    "op13_license_scan": ("licenses", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f"gridloom.llm.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"gridloom.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
