"""Registry of the queries over the driver's tables and their DuckDB SQL.

Each query applies operators of this package to whole tables. ``@query(sql)`` registers
a function under its name; without SQL the query is held by unit tests alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "entity_rollup"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from siltstone.plans import operator_queries, relational_queries, text_queries, time_queries  # noqa: E402, F401  they register themselves
