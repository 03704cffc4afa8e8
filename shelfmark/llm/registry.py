"""The queries of the training-data operators and their oracles."""

from __future__ import annotations

from shelfmark.llm import op1_query, op10_query, op11_query, op12_query, op13_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query

MODULES = (op1_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query, op10_query, op11_query, op12_query, op13_query)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
