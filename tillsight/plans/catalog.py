"""Registry of named queries: Spark builder + independent DuckDB oracle statement.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the given
tables, builds the canonical fact with Spark and applies one operator. Its
oracle is ANSI SQL over the same parquet tables, written independently (no
shared code path), so a match is evidence that the operator is right.

Double columns are rounded to 4 decimals on both sides so that summation
order does not decide the comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillsight.functions.core import rounded
from tillsight.sources.tables import FACT_SQL


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, digits: int = 4):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def with_fact(sql: str) -> str:
    """Prefix an oracle statement with the shared fact CTEs (``lines``, ``fact``, ``stock``)."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {FACT_SQL},\n{body[5:]}"
    return f"WITH {FACT_SQL}\n{body}"


def r4(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4) AS {alias}"
