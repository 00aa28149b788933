"""A register of queries over the transit tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.transit import Transit, sql


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, check: str | None = None, more: str = "") -> Callable:
        """Register a function of the transit tables under its name; check is DuckDB SQL over the same tables."""

        def add(make: Callable[[Transit], DataFrame]) -> Callable[[Transit], DataFrame]:
            self.queries[make.__name__] = lambda spark, sf_dir: make(Transit(spark, sf_dir))
            if check:
                self.sql[make.__name__] = sql(check, more)
            return make

        return add
