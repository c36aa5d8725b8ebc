"""Registered queries over the given tables, with DuckDB SQL for each where SQL can express it."""

from __future__ import annotations


def _modules():
    from carbonloom.queries import ledger, matcher, text

    return (ledger, matcher, text)


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
