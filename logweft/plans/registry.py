"""A query is a callable on (session, folder) with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name."""

        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return register
