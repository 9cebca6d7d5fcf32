"""Named queries over the warehouse, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # days and windows are those of UTC, whatever session the caller built
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def r6(col: str | Column) -> Column:
    return F.round(col, 6)


def values_sql(rows: list[tuple], names: str) -> str:
    """Fixed rows as a SQL table expression, numbered from 1 in their order."""

    def literal(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}e0" if isinstance(v, float) else repr(v)

    body = ", ".join("(" + ", ".join(map(literal, (n, *row))) + ")" for n, row in enumerate(rows, 1))
    return f"(VALUES {body}) AS {names}"
