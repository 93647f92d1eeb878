"""Queries and SQL of the training-data operators."""

from __future__ import annotations

# Imported here, so that a missing library shows when this module is imported, where callers can do without it.
from tarazu.llm import p1_queries, p2_queries, p3_queries, p4_queries, p6_queries, p7_queries, p8_queries, p9_queries

MODULES = (p1_queries, p2_queries, p3_queries, p4_queries, p6_queries, p7_queries, p8_queries, p9_queries)


def _merged(what: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(module, what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
