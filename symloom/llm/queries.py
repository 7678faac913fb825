"""All queries of the text operators with their SQL twins."""

from __future__ import annotations

from symloom.llm import document_queries, source_queries

_MODULES = (source_queries, document_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
