"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that defines a function of that name
MODULES = {
    "op1_pii": "pii",
    "op2_mixing": "mixing",
    "op3_language_id": "language_id",
    "op4_toxicity": "toxicity",
    "op5_exact_dedup": "exact_dedup",
    "op6_near_dedup": "near_dedup",
    "op7_packing": "packing",
    "op8_sharding": "sharding",
    "op9_token_counts": "token_counts",
    "op10_nearest": "nearest",
    "op11_quality": "quality",
    "op12_whitening": "whitening",
    "op13_ranked_search": "lexical",
}


def queries() -> dict:
    return {name: getattr(import_module(f"pricetide.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in dict.fromkeys(MODULES.values()):
        found |= getattr(import_module(f"pricetide.llm.{module}"), "ORACLE", {})
    return found
