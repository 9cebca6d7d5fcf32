"""Mergeable running statistics: (feature, count, mean, M2) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_SCHEMA = "feature string, count double, mean double, M2 double"


def moments(value: str) -> Column:
    """(n, mean, m2) of a column; nulls are not observations."""
    n = F.count(value).cast("double")
    return F.struct(
        n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2")
    )


def stats_long(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One pass over a wide table: (groups, feature, count, mean, M2) rows."""
    totals = df.groupBy(*groups).agg(*[moments(f).alias(f) for f in features])
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f)["n"].alias("count"),
                F.col(f)["mean"].alias("mean"),
                F.col(f)["m2"].alias("M2"),
            )
            for f in features
        ]
    )
    return totals.select(*groups, F.inline(rows)).where("count > 0")


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """State rows of a wide feature table."""
    return stats_long(df, [], features)


def merge_stats(*parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Merge any number of state tables.

    Sums are taken around the smallest mean, so little cancels when the means are
    large beside their spread; every step is a partial sum in each task, whatever
    the number of parts.
    """
    keys = [*groups, "feature"]
    rows = reduce(DataFrame.unionByName, parts).where("count > 0")
    # means around the smallest one keep their low digits
    base = rows.groupBy(*keys).agg(F.min("mean").alias("base"))
    off = F.col("mean") - F.col("base")
    return (
        rows.join(base, keys)
        .groupBy(*keys)
        .agg(
            F.sum("count").alias("n"),
            F.first("base").alias("base"),
            F.sum(F.col("count") * off).alias("s1"),
            F.sum(F.col("count") * off * off).alias("s2"),
            F.sum("M2").alias("m2"),
        )
        .select(
            *keys,
            F.col("n").alias("count"),
            (F.col("base") + F.col("s1") / F.col("n")).alias("mean"),
            (F.col("m2") + F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))).alias("M2"),
        )
    )
