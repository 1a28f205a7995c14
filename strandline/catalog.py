"""All registered queries of the library with their DuckDB twins."""

from __future__ import annotations

from .plans import batch, dense, live, measures, motion, pixels, recon, rules, selection, streams

_PLANS = (streams, motion, pixels, measures, selection, rules, live, recon, dense, batch)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
