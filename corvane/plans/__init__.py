"""Registered queries and, for those that SQL can express, the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "evaluation", "panels", "preferences", "nested", "relational")


def registered() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        m = import_module(f"{__name__}.{name}")
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
