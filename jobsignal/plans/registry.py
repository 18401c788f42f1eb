"""Query registry: name -> (Spark builder, DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | Callable[[], str] | None
    ids: str

    def oracle(self) -> str | None:
        return self.sql() if callable(self.sql) else self.sql


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | Callable[[], str] | None = None, ids: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ids)
        return fn

    return deco
