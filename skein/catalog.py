"""Registry of the engine's queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_PLANS = ["retrieval", "documents", "web", "discovery", "sync", "store", "scope", "memory", "settings"]


def _plans() -> list:
    return [importlib.import_module(f"skein.plans.{p}") for p in _PLANS]


def queries() -> dict[str, Callable]:
    return {k: f for m in _plans() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _plans() for k, s in m.ORACLE.items()}
