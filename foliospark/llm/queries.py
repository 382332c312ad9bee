"""Queries of the thirteen operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: operator number -> module, query function, SQL constant (None: SQL cannot express it)
_OPS = [
    ("exact_dedup", "op1_exact_dedup", "OP1_SQL"),
    ("chat_format", "op2_chat_format", "OP2_SQL"),
    ("line_dedup", "op3_line_dedup", None),
    ("language_id", "op4_language_id", None),
    ("licenses", "op5_license_scan", None),
    ("packing", "op6_best_fit_packing", None),
    ("quality", "op7_quality_knn", None),
    ("near_dedup", "op8_setsketch_dedup", None),
    ("mixing", "op9_pfair_mixing", None),
    ("ann", "op10_graph_search", None),
    ("collocations", "op11_collocations", None),
    ("alignment", "op12_token_alignment", None),
    ("secret_scan", "op13_secret_scan", None),
]


def queries() -> dict:
    return {fn: getattr(import_module(f"{__package__}.{mod}"), fn) for mod, fn, _ in _OPS}


def oracle_sql() -> dict[str, str]:
    return {fn: getattr(import_module(f"{__package__}.{mod}"), sql) for mod, fn, sql in _OPS if sql}
