"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "substring_dedup": ("op1_substring_dedup", "OP1_SQL"),
    "warc": ("op2_warc", "OP2_SQL"),
    "edit_embedding": ("op3_fingerprints", None),
    "language_id": ("op4_language_id", None),
    "jaccard_join": ("op5_jaccard_join", "OP5_SQL"),
    "secrets": ("op6_secrets", None),
    "packing": ("op7_packing", None),
    "exact_dedup": ("op8_exact_dedup", "OP8_SQL"),
    "bpe": ("op9_bpe", None),
    "token_counts": ("op10_token_counts", None),
}


def _get(module: str, name: str):
    return getattr(importlib.import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {query: _get(module, query) for module, (query, _) in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {query: _get(module, sql) for module, (query, sql) in _MODULES.items() if sql}
