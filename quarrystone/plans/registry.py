"""Collects the query modules of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.plans import advanced_queries, curation_queries, design_queries, event_queries, fill_queries, further_queries, inference_queries, metric_queries, unit_queries

MODULES = (metric_queries, curation_queries, design_queries, inference_queries, event_queries, further_queries, advanced_queries, fill_queries, unit_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
