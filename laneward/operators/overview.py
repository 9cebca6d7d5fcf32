"""Overview figures and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# two period means closer than this count as equal
STABLE_WITHIN = 0.005
ALERT_HOURS = 24


def active_alerts(alerts: DataFrame, as_of: str, hours: int = ALERT_HOURS) -> DataFrame:
    """(type, severity, n_alerts) of alerts in (as_of - hours, as_of]."""
    end = F.lit(as_of).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    recent = alerts.where((ts > end - F.expr(f"interval {hours} hours")) & (ts <= end))
    return recent.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def trend_label(now: Column, before: Column) -> Column:
    return (
        F.when(before.isNull() | (F.abs(now - before) < STABLE_WITHIN), "stable")
        .when(now < before, "decreasing")
        .otherwise("increasing")
    )


def risk_trend(scores: DataFrame, period: str = "week") -> DataFrame:
    """(period_start, mean_score, risk_trend) per calendar period.

    The window runs over one row per period.
    """
    start = F.date_trunc(period, F.col("created_at").cast("timestamp"))
    means = scores.groupBy(start.alias("period_start")).agg(
        F.avg("risk_score").alias("mean_score"), F.count(F.lit(1)).alias("n_requests")
    )
    by_time = Window.partitionBy(F.lit(1)).orderBy("period_start")
    before = F.lag("mean_score").over(by_time)
    return means.withColumn("risk_trend", trend_label(F.col("mean_score"), before))


def overview_kpis(
    requests: DataFrame,
    scores: DataFrame,
    alerts: DataFrame,
    deliveries: DataFrame,
    as_of: str,
    period_days: int = 7,
    approximate: bool = False,
) -> DataFrame:
    """One row of overview figures.

    requests: supplier, lane. scores: created_at, risk_score. alerts: ts, type,
    severity. deliveries: on_time (boolean). The trend compares the last
    ``period_days`` with the ones before. Each input gives one row of sums.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    end = F.lit(as_of).cast("timestamp")
    at = F.col("created_at").cast("timestamp")
    cut = end - F.expr(f"interval {period_days} days")
    floor = end - F.expr(f"interval {2 * period_days} days")

    parts = [
        requests.agg(distinct("supplier").alias("total_suppliers"), distinct("lane").alias("active_routes")),
        active_alerts(alerts, as_of).agg(F.coalesce(F.sum("n_alerts"), F.lit(0)).alias("active_alerts")),
        deliveries.agg((F.avg(F.col("on_time").cast("double")) * 100).alias("reliability_score")),
        scores.where((at > floor) & (at <= end)).agg(
            F.avg(F.when(at > cut, F.col("risk_score"))).alias("_now"),
            F.avg(F.when(at <= cut, F.col("risk_score"))).alias("_before"),
        ),
    ]
    # four single rows, each with its own columns, folded into one
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    return row.withColumn("risk_trend", trend_label(F.col("_now"), F.col("_before"))).select(
        "total_suppliers",
        "active_routes",
        "active_alerts",
        "reliability_score",
        "risk_trend",
        F.lit(as_of).alias("last_updated"),
    )
