"""Registry of queries: a plan and, where SQL can express it, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.windows import rounded

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, places: int | None = 6) -> None:
        """Registers a query; doubles are rounded to ``places`` as ``columns`` does in SQL."""
        self.queries[name] = query if places is None else lambda spark, sf_dir: rounded(query(spark, sf_dir), places)
        if sql is not None:
            self.sql[name] = sql


def columns(exact: str, real: str = "", source: str = "", places: int = 6) -> str:
    """A SELECT of exact columns and of rounded ones."""
    names = [*exact.split(), *(f"round({c}, {places}) + 0.0 AS {c}" for c in real.split())]
    return f" SELECT {', '.join(names)} FROM {source}"
