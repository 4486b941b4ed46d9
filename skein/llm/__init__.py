"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

_MODULES = ["packing", "langid", "pii", "mixing", "ngram_join", "token_counts", "telephony", "quality", "html_text", "exact_dedup", "codebooks", "hnsw", "merkle"]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in importlib.import_module(f"{__name__}.{m}").ORACLE.items()}
