"""All queries of the library outside its subpackage for training data, with their oracle SQL."""

from __future__ import annotations

from .plans import claims_v2, evidence, models, records, texts

MODULES = (claims_v2, texts, models, evidence, records)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
