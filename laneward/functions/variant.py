"""Helpers over VARIANT values: missing, null and badly typed stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null where it does not parse."""
    return F.try_parse_json(text)


def with_variant(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a variant column that later filters do not compute again.

    Filters move below projections and take a copy of the parsed expression for
    each use; they cannot move below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def is_kind(value: Column, name: str) -> Column:
    """Whether a variant's outer type is OBJECT, ARRAY, STRING or VOID."""
    shape = F.schema_of_variant(value)
    return F.startswith(shape, F.lit(f"{name}<")) if name in ("OBJECT", "ARRAY") else shape == name


def field(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def is_missing(value: Column, path: str) -> Column:
    return field(value, path).isNull()


def number(value: Column, path: str) -> Column:
    """A JSON number as double; texts do not count."""
    return F.when(~is_kind(field(value, path), "STRING"), field(value, path, "double"))
