"""Named queries over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Float results at a fixed precision: sums in a cluster have no fixed order."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def sql_round(expr: str, digits: int) -> str:
    """The same rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0.0)"
