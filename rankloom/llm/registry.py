"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from rankloom.llm import (
    decontamination,
    html_main,
    media,
    near_dup,
    packing,
    quality,
    repeats,
    resharding,
    token_counts,
    toxicity,
    url_reputation,
    vector_codes,
    turn_trie,
)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (
    resharding,
    toxicity,
    url_reputation,
    decontamination,
    html_main,
    media,
    near_dup,
    packing,
    quality,
    repeats,
    token_counts,
    vector_codes,
    turn_trie,
):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
