"""All registered queries of the engine, by name, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "score_scheme"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with SQL where SQL can express it."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from brickwork.plans import aggregates, domain, enrichment, filters, gaps, ingest, joins, loaders, mutation, ordering, pipelines, prose, registers, risk, schemes, text, webdata  # noqa: E402, F401
