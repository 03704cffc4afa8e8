"""All queries and their oracles."""

from __future__ import annotations

from workloads import change_queries, evidence_queries, name_queries, path_queries, reader_queries, sort_queries, standard_sql

MODULES = (path_queries, evidence_queries, sort_queries, name_queries, change_queries, reader_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()} | standard_sql.ORACLES
