"""Queries by name, with the SQL that gives the same rows.

Many operators look for constructs that the tables don't hold. Their queries read made-up inputs
that are computed from ``documents`` by SQL that Spark and DuckDB both understand: no backslashes,
no lambdas, ``chr(10)`` for a line end. ``{docs}`` stands for the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, name: str = "documents") -> DataFrame:
    """A made-up input as a DataFrame."""
    return spark.sql(sql.replace("{docs}", "{_t}"), _t=table(spark, sf_dir, name))


def plain(sql: str, name: str = "documents") -> str:
    """The same input as SQL over the registered tables."""
    return "(" + sql.replace("{docs}", name) + ")"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep
