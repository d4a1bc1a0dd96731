"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, each with the DuckDB SQL of the same rows where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
