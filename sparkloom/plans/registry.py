"""The registered queries and their SQL."""

from __future__ import annotations

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the equivalent SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
