"""Collects queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import fixtures as fx

AS_OF, SELF = fx.AS_OF, fx.SELF
NOW = fx.AS_OF_SQL
OWN = f"lower(from_email) = '{SELF}'"
CORR = "folder IN ('INBOX', 'SENT', 'ARCHIVE')"
AWAKE = f"(snoozed_until IS NULL OR snoozed_until <= {NOW})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given and derived tables of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fx.TABLES:
            return fx.table(self.spark, self.sf_dir, name)
        if name in fx.SOURCES:
            return fx.source(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def check(name: str, sql: str | None = None, needs: tuple[str, ...] = ("mail",)):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` reads the derived
    tables in ``needs`` by name."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fx.duck_sql(sql, *needs)
        return fn
    return register
