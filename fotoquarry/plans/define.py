"""How queries are written down: a function of the catalogue beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog, with_views


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, make: Callable[[Catalog], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: make(Catalog(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = with_views(sql)
