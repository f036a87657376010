"""Queries of the operators of this package, and SQL where it can express them."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, periodic_runs, sharding, toxicity, url_filter, vector_codes

MODULES = (ngram_join, toxicity, sharding, embedding_dedup, mixing, exact_dedup, language_id, bpe, url_filter, line_dedup, periodic_runs, vector_codes, packing)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
