"""All registered queries of the core and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["arm_queries", "audit_queries", "label_queries", "release_queries", "repair_queries", "skew_queries", "stream_queries"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"tarazu.plans.{name}")
        for key, value in getattr(module, what).items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
