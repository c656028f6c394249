"""All queries of the package by name, with their DuckDB counterparts."""

from __future__ import annotations

from docmill.plans import heading_queries, markdown_queries, office_queries, proof_queries, sheet_queries, text_queries

MODULES = (proof_queries, text_queries, heading_queries, sheet_queries, markdown_queries, office_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
