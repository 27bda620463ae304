"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from . import collocations, decontamination, exact_dedup, importance, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality, sharding, suffix_dedup, token_files

MODULES = (language_id, sharding, mixing, quality, decontamination, suffix_dedup, lm_scoring, line_dedup, near_dedup, token_files, importance, exact_dedup, collocations)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
