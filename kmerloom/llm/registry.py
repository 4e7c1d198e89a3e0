"""Queries of this subpackage and their SQL, gathered for the query registry."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, html_extract, lm_score, ngram_join, packing, pii, simple8b, toxicity

MODULES = (simple8b, chat, toxicity, lm_score, pii, decontaminate, html_extract, packing, fingerprint, ngram_join)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
