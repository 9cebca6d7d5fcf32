"""Batch analysis: requests and feature tables to scores and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from laneward.operators.assemble import assemble_raw, attach_pressure
from laneward.operators.normalize import REQUEST_ORDER, normalize_running
from laneward.operators.scoring import (
    FeatureSpec,
    feature_specs,
    mitigation_column,
    risk_score,
    with_factors,
)
from laneward.session import cut_lineage
from laneward.sources.requests import report_rows


def analyze(
    requests: DataFrame,
    feature_tables: Sequence[DataFrame],
    pressure: DataFrame | None = None,
    weights: DataFrame | Sequence[FeatureSpec] | None = None,
    state: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Scored requests: normalised features, risk_score, risk_label, factors.

    feature_tables hold request_id and feature columns, one row per request;
    ``pressure`` is (start, global_risk). After the normaliser everything is an
    expression on the request row.
    """
    specs = feature_specs(weights)
    if pressure is not None:
        requests = attach_pressure(requests, pressure)
    # read for the bounds, the summaries and the rows; the joins run once
    raw = cut_lineage(assemble_raw(requests, feature_tables, specs))
    norm = normalize_running(raw, [s.feature for s in specs], REQUEST_ORDER, state=state, buckets=buckets)
    return with_factors(risk_score(norm, specs), specs)


def reports(
    scored: DataFrame,
    weights: DataFrame | Sequence[FeatureSpec] | None = None,
    strategies: DataFrame | None = None,
) -> DataFrame:
    """Nested report rows of scored requests."""
    names = [s.feature for s in feature_specs(weights)]
    return report_rows(scored, mitigation_column(strategies), names)
