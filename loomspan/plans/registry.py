"""Registered queries over the test tables and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def query(sql: str | None = None, name: str | None = None):
    """Register a query of (read, spark), ``read(table)`` giving a table."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: f(lambda table: spark.read.parquet(f"{d}/{table}.parquet"), spark)
        if sql:
            SQL[key] = sql
        return f

    return add


def tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_WS}'), lambda x: x <> '')"


def words(t: str) -> str:
    return tokens(f"lower({t})")


def trimmed(t: str) -> str:
    return f"regexp_replace({t}, '^{_WS}|{_WS}$', '', 'g')"


def ngrams(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], chr(1)))"


def repetition(w: str, n: int = 3) -> str:
    g = ngrams(w, n)
    return f"case when len({w}) < {n} then 0.0::double else 1 - len(list_distinct({g}))::double / len({g}) end"


def contained(t: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({t}, '{p.replace(chr(39), chr(39) * 2)}')::int" for p in phrases) + ")"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
