"""The core's queries and their oracle SQL, by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is the same result for the oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register the core's queries."""
    from threadloom.plans import graph_queries, io_queries, mirror_queries, nested_queries, text_queries, url_queries, work_queries  # noqa: F401
