"""The registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from ledgerloom.plans import acceptance_queries, account_queries, kept_queries, ledger_queries, match_queries, record_queries, review_queries, source_queries

_MODULES = (ledger_queries.query, record_queries.query, match_queries.query, source_queries.query, account_queries.query, kept_queries.query, review_queries.query, acceptance_queries.query)


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.sql.items()}
