"""The decorator that enters a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracles: dict) -> Callable:
    def query(name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return query
