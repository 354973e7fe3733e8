"""Example queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables. Their schemas are read once per process: the files never change."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def leaf(field: str, operator: str, value=None, **more) -> dict:
    return {"field": field, "operator": operator, "value": value, **more}


def both(*conditions: dict) -> dict:
    return {"type": "group", "logicalOperator": "AND", "conditions": list(conditions)}


def either(*conditions: dict) -> dict:
    return {"type": "group", "logicalOperator": "OR", "conditions": list(conditions)}
