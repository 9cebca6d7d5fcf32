"""Feature assembly: one wide row per request from the feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.dims import small_rows
from laneward.operators.joins import lookup_join
from laneward.operators.ordered import last_known
from laneward.operators.scoring import FeatureSpec, feature_specs


def assemble_raw(
    requests: DataFrame,
    feature_tables: Sequence[DataFrame],
    weights: DataFrame | Sequence[FeatureSpec] | None = None,
    id_col: str = "request_id",
) -> DataFrame:
    """Left-join feature tables keyed by request and fill absent values.

    All tables are keyed by the same unique id, so the joins share one
    partitioning of the requests. Columns that no weight names are carried.
    """
    specs = feature_specs(weights)
    joined = requests
    for table in feature_tables:
        joined = joined.join(table, id_col, "left")
    filled = {
        s.feature: F.coalesce(F.col(s.feature).cast("double"), F.lit(s.default_value))
        if s.feature in joined.columns
        else F.lit(s.default_value)
        for s in specs
    }
    return joined.withColumns(filled)


def attach_by_lane(requests: DataFrame, lane_table: DataFrame) -> DataFrame:
    """(request_id, features) of a table with one feature row per lane."""
    asked = requests.select("request_id", "lane")
    return lookup_join(asked, lane_table, "lane", F.col("request_id")).drop("lane")


def to_long(df: DataFrame, features: Sequence[str], id_col: str = "request_id") -> DataFrame:
    """(id, feature, value) rows of a wide table."""
    return df.select(
        id_col,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                    for f in features
                ]
            )
        ),
    )


PERIOD_LIMIT = 4096


def pressure_periods(months: DataFrame) -> DataFrame:
    """(month 'YYYY-MM', global_risk) rows as (start, global_risk); bad months drop out."""
    start = F.try_to_timestamp("month", F.lit("yyyy-MM"))
    return months.select(start.alias("start"), "global_risk").where("start is not null")


def attach_pressure(requests: DataFrame, periods: DataFrame, created: str = "created_at") -> DataFrame:
    """Add ``global_risk`` of the newest period started at or before each request.

    A calendar of periods is short and becomes an ordered literal, looked up
    per row; a table of more than PERIOD_LIMIT periods takes the as-of path, which
    carries the whole request rows. Both give each row once, whatever its id is.
    """
    newest = periods.groupBy(F.col("start").cast("timestamp").alias("start")).agg(
        F.max("global_risk").alias("global_risk")
    )
    at = F.col(created).cast("timestamp")
    rows = small_rows(newest, PERIOD_LIMIT)
    if rows is None:
        whole = requests.select(F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("_row"), at.alias("_at"))
        tie = F.col("_row.request_id") if "request_id" in requests.columns else F.lit(None)
        timeline = whole.select(
            "_at", F.lit(1).alias("_side"), tie.alias("_tie"), "_row", F.lit(None).cast("double").alias("_risk")
        ).unionByName(
            newest.where("start IS NOT NULL").select(
                F.col("start").alias("_at"),
                F.lit(0).alias("_side"),
                F.lit(None).alias("_tie"),
                F.lit(None).cast(whole.schema["_row"].dataType).alias("_row"),
                F.col("global_risk").cast("double").alias("_risk"),
            )
        )
        found = last_known(timeline, [], ["_at", "_side", "_tie"], "_risk").where("_side = 1")
        return found.select("_row.*", "_risk").withColumn("global_risk", F.col("_risk")).drop("_risk")
    rows = [r for r in rows if r["start"] is not None and r["global_risk"] is not None]
    if not rows:
        return requests.withColumn("global_risk", F.lit(None).cast("double"))
    calendar = F.array(
        *[
            F.struct(F.lit(r["start"]).alias("start"), F.lit(float(r["global_risk"])).alias("risk"))
            for r in sorted(rows, key=lambda r: r["start"])
        ]
    )
    passed = F.filter(calendar, lambda p: p["start"] <= at)
    return requests.withColumn("global_risk", F.try_element_at(passed, F.lit(-1))["risk"])
