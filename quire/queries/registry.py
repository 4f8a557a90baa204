"""How a module registers its queries."""

from __future__ import annotations

from quire.views import Library


def registry():
    """queries, oracles and the decorator that fills them: @query(name, sql)."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = lambda spark, folder: f(Library(spark, folder))
            if sql:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, query
