"""Queries of the training-data operators, one for each."""

from __future__ import annotations

from corpusgrep.llm import bpe, minhash, nearest, packing, pii, quality, sharding, suffix_dedup, token_files, toxicity

_MODULES = [token_files, suffix_dedup, minhash, pii, packing, bpe, toxicity, nearest, quality, sharding]


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
