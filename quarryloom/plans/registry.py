"""The library's queries, by name, and their SQL."""

from __future__ import annotations

from quarryloom.plans import code_queries, delivery_queries, ingest_queries, more_queries, registry_queries, retrieval_queries, review_queries, search_queries, text_queries

MODULES = (text_queries, search_queries, registry_queries, ingest_queries, review_queries, code_queries, more_queries, retrieval_queries, delivery_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "hybrid_search"
