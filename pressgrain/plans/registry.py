"""Registry of runnable queries and the DuckDB SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressgrain.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RAW_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``sql`` may use the ``fx_*`` views freely."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixtures.Tables(spark, sf_dir))

        run.__name__ = key
        run.__wrapped_module__ = fn.__module__
        QUERIES[key] = run
        if sql is not None:
            _RAW_SQL[key] = sql
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions of every ``fx_*`` view it mentions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bfx_\w+", text))):
            if name not in ordered:
                visit(fixtures.VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({fixtures.VIEWS[name]})" for name in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def resolve() -> None:
    """Build the oracle texts once every view is registered."""
    for key, sql in _RAW_SQL.items():
        ORACLES[key] = with_views(sql)
