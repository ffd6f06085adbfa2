"""Collects the query modules of this folder."""

from __future__ import annotations

from quarrystone.llm import catalog_queries, overlap_queries, split_queries, survivor_queries, text_queries, truncation_queries, vector_queries

MODULES = (survivor_queries, catalog_queries, overlap_queries, truncation_queries, text_queries, split_queries, vector_queries)

QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
