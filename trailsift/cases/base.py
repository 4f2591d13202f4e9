"""Registry of queries over the driver tables, with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailsift.cases import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use any fixture name as a table."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\bfx_\w+", text):
            if word in fx.SQL and word not in needed:
                visit(fx.SQL[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({fx.SQL[name]})" for name in needed)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\b", "", body, count=1)
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\b", "", body, count=1)
    return f"WITH {ctes}\n{body}"


def oracles() -> dict[str, str]:
    """All SQL twins, complete with their fixtures."""
    return {name: with_fixtures(sql) for name, sql in _SQL.items()}
