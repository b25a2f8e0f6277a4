"""Registered queries of the engine and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "view_queries", "metric_queries", "cluster_queries", "lifecycle_queries", "source_queries")
FLAGSHIP = "exact_dup_summary"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    _r = importlib.import_module(f"lakepress.plans.{_m}").R
    QUERIES.update(_r.queries)
    ORACLE_SQL.update(_r.sql)
