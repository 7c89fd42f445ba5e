"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> (module, function, function that gives its SQL or None)
_QUERIES = {
    "op1_quality_rules": ("quality", "op1_quality_rules", "oracle_quality_rules"),
    "op4_mixing": ("mixing", "op4_mixing", "oracle_mixing"),
    "op9_simhash_dedup": ("simhash", "op9_simhash_dedup", None),
    "op7_media_columns": ("media", "op7_media_columns", None),
    "op10_packing": ("packing", "op10_packing", None),
    "op5_pii": ("pii", "op5_pii", "oracle_pii"),
    "op8_lm_scoring": ("lm", "op8_lm_scoring", None),
    "op2_line_dedup": ("lines", "op2_line_dedup", None),
    "op3_token_counts": ("token_scan", "op3_token_counts", None),
    "op6_chat_rotation": ("chat", "op6_chat_rotation", "oracle_chat_rotation"),
    "op11_whitening": ("whitening", "op11_whitening", None),
    "op12_toxicity": ("toxicity", "op12_toxicity", None),
}


def _get(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: _get(module, f) for q, (module, f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: _get(module, sql)() for q, (module, _, sql) in _QUERIES.items() if sql}
