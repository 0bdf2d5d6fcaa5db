"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

from tidemark.plans import catalog, clustering, content, frontier, hybrid, ingest, observability, requests, search, signals, tables

_PLANS = (catalog, observability, content, signals, search, clustering, tables, requests, frontier, ingest, hybrid)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
