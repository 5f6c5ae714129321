"""Queries and SQL of the corpus operators."""

from __future__ import annotations

import importlib

_MODULES = ("url_filter", "media", "mixing", "exact_dedup", "bpe", "lm_scoring", "language_id", "ngram_join", "warc", "pii", "token_files", "vector_codes", "prefix_trie")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"kinweave.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
