"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from lexiquarry.plans import q_direct, q_fulltext, q_headword, q_library, q_upkeep

_MODULES = (q_headword, q_fulltext, q_library, q_direct, q_upkeep)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
