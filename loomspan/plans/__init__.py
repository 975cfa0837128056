"""Queries over the test tables that show each operator, with SQL of the same result."""

from __future__ import annotations


def queries() -> dict:
    from . import curation, evaluation, flows, pairs  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from .registry import SQL

    return dict(SQL)
