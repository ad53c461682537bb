"""All constants of the matching engine in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, scoring, evaluation and audit; pass a changed copy to any operator."""

    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    rrf_k: int = 60
    pool: int = 50
    rerank_fraction: float = 0.5
    tail_share: float = 0.95
    alpha: float = 0.5
    relevance_threshold: float = 0.5
    selection_threshold: float = 0.5
    four_fifths: float = 0.8
    max_penalty: float = 0.95
    min_chars: int = 50
    max_query_chars: int = 20_000
    max_files: int | None = 50
    as_of_year: int = 2026
    budget_usd: float = 5.0


DEFAULT = Config()

#: Weights of D1..D4 by role preset (fixed values).
WEIGHT_PRESETS = {
    "default": (0.40, 0.35, 0.15, 0.10),
}
#: USD per million tokens, in and out, by kind of model (fixed values).
PRICES = {"small": (0.15, 0.60), "large": (2.50, 10.00), "third": (3.00, 15.00), "local": (0.0, 0.0)}
