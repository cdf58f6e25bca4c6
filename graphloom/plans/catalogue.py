"""All queries of the core and their SQL."""

from __future__ import annotations

from graphloom.plans import graph_queries, record_queries, text_queries, training_data

MODULES = [training_data, graph_queries, text_queries, record_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
