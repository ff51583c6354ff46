"""Names of the registered queries; see the modules for what they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import accounting, decisions, ledgers, matching_queries, observations, oracles, page_queries, relational, series_queries, storage_queries
from tallyloom.plans.adapter import Views

_MODULES = (series_queries, relational, matching_queries, ledgers, decisions, observations, page_queries, storage_queries, accounting)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_queries.ranking(Views(spark, sf_dir))


def queries() -> dict:
    def bound(f):
        return lambda spark, sf_dir: f(Views(spark, sf_dir))

    return {name: bound(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()} | oracles.SQL
