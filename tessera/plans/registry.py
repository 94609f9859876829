"""Where queries and their SQL are collected."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under a name, with the SQL that gives the same rows."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
