"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from .operators import decisions, documents, evaluation_queries, feature_queries, live_reports, market, orders, panels, portfolio, power, quality, refit, reports, risk_rules, split_metrics
from .sources import store
from .streaming import live, stateful

MODULES = [feature_queries, evaluation_queries, market, decisions, documents, reports, live_reports, orders, panels, portfolio, power, quality, refit, risk_rules, split_metrics, store, live, stateful]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
