"""Weights, scores and ranked factors.

A request is one wide row, and the weight table has one row per feature column,
so contributions, score and ranking are expressions on that row: nothing is
exploded, joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneward.dims import DEFAULT_IMPACT, FEATURES, MITIGATION, ROUTE_OPTIONS
from laneward.functions.risk import (
    NEUTRAL,
    clip01,
    factor_category,
    factor_display,
    factor_percent,
    reliability_100,
    risk_label,
    score_100,
)


@dataclass(frozen=True)
class FeatureSpec:
    """A scored feature: column name, weight, value when absent, report text."""

    feature: str
    weight: float
    default_value: float = 0.0
    impact: str = DEFAULT_IMPACT


DEFAULT_SPECS = [FeatureSpec(*row) for row in FEATURES]


def feature_specs(weights: DataFrame | Sequence[FeatureSpec] | None) -> list[FeatureSpec]:
    """Weights as a list; none or an empty table means the built-in ones.

    A table needs (ordinal, feature, weight) and may give default_value and
    impact. Each of its rows names a column, so its size is that of a schema.
    """
    if weights is None:
        return DEFAULT_SPECS
    if not isinstance(weights, DataFrame):
        return list(weights) or DEFAULT_SPECS
    rows = weights.collect()  # one row per feature column
    known = {s.feature: s for s in DEFAULT_SPECS}
    specs = []
    for row in sorted((r.asDict() for r in rows), key=lambda r: r["ordinal"]):
        base = known.get(row["feature"], FeatureSpec(row["feature"], 0.0))
        default, impact = row.get("default_value"), row.get("impact")
        specs.append(
            FeatureSpec(
                row["feature"],
                float(row["weight"]),
                base.default_value if default is None else float(default),
                base.impact if impact is None else impact,
            )
        )
    return specs or DEFAULT_SPECS


def _value(df: DataFrame, spec: FeatureSpec) -> Column:
    if spec.feature not in df.columns:
        return F.lit(NEUTRAL)
    return F.coalesce(F.col(spec.feature).cast("double"), F.lit(NEUTRAL))


def _contributions(df: DataFrame, specs: Sequence[FeatureSpec]) -> Column:
    total = sum(s.weight for s in specs)
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("ordinal"),
                F.lit(s.feature).alias("feature"),
                F.lit(s.weight).alias("weight"),
                _value(df, s).alias("value"),
                (F.lit(s.weight) * _value(df, s) / total).alias("share"),
            )
            for n, s in enumerate(specs, start=1)
        ]
    )


def weighted_contrib(
    norm: DataFrame, weights: DataFrame | Sequence[FeatureSpec] | None = None, id_col: str = "request_id"
) -> DataFrame:
    """Long rows (id, ordinal, feature, weight, value, share), one per weight."""
    return norm.select(id_col, F.inline(_contributions(norm, feature_specs(weights))))


def risk_score_column(df: DataFrame, specs: Sequence[FeatureSpec]) -> Column:
    """Sum of weight times value, clipped; not divided by the weight total."""
    score = F.lit(0.0)
    for spec in specs:
        score = score + F.lit(spec.weight) * _value(df, spec)
    return clip01(score)


def risk_score(norm: DataFrame, weights: DataFrame | Sequence[FeatureSpec] | None = None) -> DataFrame:
    """Add risk_score and risk_label to a wide normalised table."""
    score = risk_score_column(norm, feature_specs(weights))
    return norm.withColumn("risk_score", score).withColumn("risk_label", risk_label(F.col("risk_score")))


def risk_score_from_long(contrib: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Score of contribution rows that are already long (one row per weight)."""
    return contrib.groupBy(id_col).agg(
        clip01(F.sum(F.col("weight") * F.col("value"))).alias("risk_score")
    )


def _impact(specs: Sequence[FeatureSpec], feature: Column) -> Column:
    text = F.create_map(*[F.lit(x) for s in specs for x in (s.feature, s.impact)])
    return F.coalesce(text[feature], F.lit(DEFAULT_IMPACT))


def _ranked(df: DataFrame, specs: Sequence[FeatureSpec]) -> Column:
    """Factors of a row, by rounded percent descending, then weight order."""
    keyed = F.transform(
        _contributions(df, specs),
        lambda c: F.struct(
            (-factor_percent(c["share"])).alias("neg_percent"),
            c["ordinal"].alias("ordinal"),
            c["feature"].alias("name"),
            risk_label(c["share"]).alias("level"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda c: F.struct(
            c["name"].alias("name"),
            c["level"].alias("level"),
            (-c["neg_percent"]).alias("percent"),
            _impact(specs, c["name"]).alias("impact"),
        ),
    )


def with_factors(df: DataFrame, weights: DataFrame | Sequence[FeatureSpec] | None = None) -> DataFrame:
    """Add ``factors``, the ranked array of (name, level, percent, impact), and
    ``risk_components``, the unrounded share of each feature."""
    specs = feature_specs(weights)
    total = sum(s.weight for s in specs)
    shares = [x for s in specs for x in (F.lit(s.feature), F.lit(s.weight) * _value(df, s) / total)]
    return df.withColumns({"factors": _ranked(df, specs), "risk_components": F.create_map(*shares)})


def factor_rows(df: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per ranked factor of a table that carries ``factors``."""
    return df.select(id_col, F.posexplode("factors").alias("pos", "factor")).select(
        id_col, (F.col("pos") + 1).alias("rank"), "factor.*"
    )


def rank_factors(factors: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Rank factor rows that arrive as a table (id, ordinal, percent, ...)."""
    window = Window.partitionBy(id_col).orderBy(F.desc("percent"), "ordinal")
    return factors.withColumn("rank", F.row_number().over(window))


def factor_impact(factors: DataFrame, weights: DataFrame | None = None, name: str = "name") -> DataFrame:
    return factors.withColumn("impact", _impact(feature_specs(weights), F.col(name)))


def factor_names(factors: DataFrame, name: str = "name") -> DataFrame:
    """Display name and category of each factor."""
    return factors.withColumn("display_name", factor_display(F.col(name))).withColumn(
        "category", factor_category(F.col(name))
    )


def score_points(df: DataFrame) -> DataFrame:
    """Score out of 100 and reliability points."""
    return df.withColumn("score_100", score_100(F.col("risk_score"))).withColumn(
        "reliability", reliability_100(F.col("risk_score"))
    )


def route_options(df: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Three route rows per scored request; reliability has no floor."""
    score = F.col("risk_score")
    options = [
        F.struct(
            F.lit(n).alias("route_no"),
            F.lit(name).alias("name"),
            (
                F.col("risk_label")
                if cut is None
                else F.when(score > cut, "High").otherwise("Medium")
            ).alias("risk"),
            F.lit(duration).alias("duration"),
            F.lit(cost).alias("cost"),
            (reliability_100(score) - points).alias("reliability"),
        )
        for n, (name, cut, points, duration, cost) in enumerate(ROUTE_OPTIONS, start=1)
    ]
    return df.select(id_col, F.inline(F.array(*options)))


def mitigation_column(strategies: DataFrame | None = None) -> Column:
    """Strategy map; a table (name, text), shown whole on every report, replaces the built-in entries."""
    rows = None if strategies is None else strategies.collect()
    pairs = MITIGATION.items() if rows is None else [(r["name"], r["text"]) for r in rows]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def mitigation(df: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    return df.withColumn("mitigation_strategies", mitigation_column(strategies))


def with_identity(requests: DataFrame) -> DataFrame:
    """Give rows a random id and the current time where they have none.

    Only for the outer edge: store the result before it is used, since both
    values differ on every evaluation.
    """
    given = {c: F.col(c) for c in ("request_id", "created_at") if c in requests.columns}
    return requests.withColumns(
        {
            "request_id": F.coalesce(given.get("request_id", F.lit(None)), F.uuid()),
            "created_at": F.coalesce(given.get("created_at", F.lit(None)), F.current_timestamp()),
        }
    )
