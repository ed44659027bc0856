"""Collects queries and their SQL as they are defined."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, oracle: bool = True):
    """Registers a builder (spark, folder) under its name, with the SQL for the same rows."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql and oracle:
            ORACLES[build.__name__] = sql
        return build

    return register
