"""Registration of queries with their SQL oracles."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.session import configure, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; the SQL is absent where the operator is not expressible."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(configure(spark), sf_dir)
            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return register


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared directory for a write-then-read query."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ms(name: str, alias: str | None = None) -> Column:
    """Timestamp column as epoch milliseconds, comparable across engines."""
    return F.unix_millis(name).alias(alias or f"{name}_ms")


def r6(col: Column | str, alias: str) -> Column:
    return F.round(col, 6).alias(alias)
