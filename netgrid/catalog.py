"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netgrid.fixtures import fixture, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Fixture relations and given tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(*self._at, name)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query, with its DuckDB SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return f

    return add
