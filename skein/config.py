"""Retrieval and ingestion settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    pool: int
    top_k: int
    min_score: float
    per_source: int
    max_chars: int


#: Presets of the vector engine; `configured` is what the search path uses over a preset's pool and counts.
PRESETS = {
    "turbo": Retrieval(50, 10, 0.55, 2, 20_000),
    "balanced": Retrieval(100, 20, 0.50, 3, 40_000),
    "deep": Retrieval(150, 40, 0.45, 5, 60_000),
    "configured": Retrieval(100, 40, 0.40, 3, 45_000),
    "memory": Retrieval(16, 8, 0.35, 3, 45_000),
}
ALIASES = {"deep_research": "deep", "research": "deep", "fast": "turbo", "speed": "turbo", "deep-research": "deep", "max": "deep"}
#: Second table of presets, kept by the settings store: pool, top-k, per source.
SETTINGS_PRESETS = {"turbo": (50, 20, 2), "balanced": (100, 40, 3), "deep": (150, 60, 4)}
BUDGET_FREE, BUDGET_LEAST = 3, 200
#: Ends of texts that are cut or left out (fixed values).
TRUNCATED = "\n[...trecho adicional condensado por limite de densidade...]"
TURN_CUT = "\n[...additional topic snippets condensed for turn budget...]"
PRIOR_TURN = "[Prior workspace context retrieved and synthesized in conversation history]"
CHUNK_WORDS, CHUNK_OVERLAP = 1024, 200


def preset(name: str) -> Retrieval:
    key = name.lower().strip()
    return PRESETS.get(ALIASES.get(key, key), PRESETS["balanced"])
