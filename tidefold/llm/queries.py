"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name: the module that has its `query` and, where SQL can express it, its `ORACLE_SQL`.
MODULES = {
    "op1_substring_dedup": "substrings",
    "op2_minhash_near_dedup": "minhash",
    "op3_url_filter": "urls",
    "op4_embedding_near_dedup": "embeddings",
    "op5_best_fit_packing": "packing",
    "op6_chat_format": "chat",
    "op7_toxicity": "toxicity",
    "op8_nearest": "nearest",
    "op9_bpe": "bpe",
    "op10_secret_scan": "secrets",
    "op11_order_minhash": "fingerprints",
    "op12_vector_codes": "codes",
    "op13_centroids": "centroids",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
