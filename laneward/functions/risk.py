"""Scoring rules on columns (squash, clip, label, percent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5
MIN_VARIANCE = 1e-12
HIGH_FROM = 0.66
MEDIUM_FROM = 0.33


def squash(value: Column, n: Column, mean: Column, m2: Column) -> Column:
    """Logistic of the z-score; neutral below two observations."""
    variance = F.greatest(F.try_divide(m2, n - 1), F.lit(MIN_VARIANCE))
    z = (value - mean) / F.sqrt(variance)
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(n < 2, F.lit(NEUTRAL))
        .otherwise(1 / (1 + F.exp(-z)))
    )


def clip01(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def risk_label(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "High").when(score >= MEDIUM_FROM, "Medium").otherwise("Low")


def factor_percent(share: Column) -> Column:
    return F.round(share * 100, 2)


def score_100(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def reliability_100(score: Column) -> Column:
    return F.round((1 - score) * 100).cast("int")


def factor_display(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def factor_category(name: Column) -> Column:
    return (
        F.when(F.contains(name, F.lit("weather")), "weather")
        .when(F.contains(name, F.lit("strike")), "strike")
        .when(F.contains(name, F.lit("political")), "political")
        .when(F.contains(name, F.lit("sanctions")), "sanctions")
        .otherwise("other")
    )
