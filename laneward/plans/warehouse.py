"""A trade warehouse seen as requests, mentions, weather rows, shipments, edges.

The tables are an order book (orders, lineitem, customer, supplier, nation) and
an event log. A lane is a customer; a request is one (lane, day with an event).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneward.operators.assemble import attach_by_lane
from laneward.operators.features import news_features, trade_signals, weather_anomaly
from laneward.session import cut_lineage

STRIKE_ABOVE = 150.0
DAYS_BACK = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(events: DataFrame) -> DataFrame:
    """(request_id, lane, day, created_at): the end of each day a lane had events."""
    days = events.select(F.col("user_id").alias("lane"), F.to_date("ts").alias("day")).distinct()
    return days.select(
        (F.col("lane") * 100000 + F.unix_date("day")).alias("request_id"),
        "lane",
        "day",
        F.date_add("day", 1).cast("timestamp").alias("created_at"),
    )


def mentions(events: DataFrame) -> DataFrame:
    """Relevant mentions: every event but a signup; an error is negative."""
    negative = F.col("event_type") == "error"
    return events.where("event_type <> 'signup'").select(
        F.col("user_id").alias("lane"),
        F.col("event_id").alias("mention_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        negative.alias("negative"),
        (negative & (F.col("value") > STRIKE_ABOVE)).alias("strike"),
    )


def weather_rows(asked: DataFrame, events: DataFrame) -> DataFrame:
    """Seven trailing daily means per request, as (request_id, provider, day_no, temp).

    Each lane-day is handed on to the seven days it is part of, so the rows
    meet their requests by an equi join.
    """
    daily = events.groupBy(F.col("user_id").alias("lane"), F.to_date("ts").alias("on")).agg(
        F.avg("value").alias("temp")
    )
    reach = daily.select(
        "lane", "temp", F.posexplode(F.sequence(F.lit(0), F.lit(DAYS_BACK))).alias("back", "_n"), "on"
    ).select("lane", "temp", "back", F.expr("date_add(on, back)").alias("day"))
    return (
        asked.select("request_id", "lane", "day")
        .join(reach, ["lane", "day"])
        .select(
            "request_id",
            F.lit("openweather").alias("provider"),
            (DAYS_BACK + 1 - F.col("back")).alias("day_no"),
            "temp",
        )
    )


def shipments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(lane, quantity, ordered_at, shipped_at) of every order line."""
    lines = lineitem.select("l_orderkey", "l_quantity", "l_shipdate")
    heads = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(heads, lines["l_orderkey"] == heads["o_orderkey"]).select(
        F.col("o_custkey").alias("lane"),
        F.col("l_quantity").alias("quantity"),
        F.col("o_orderdate").alias("ordered_at"),
        F.col("l_shipdate").alias("shipped_at"),
    )


def pressure_days(events: DataFrame) -> DataFrame:
    """(start, global_risk): the share of errors of a day, known at its end."""
    error = (F.col("event_type") == "error").cast("double")
    return events.groupBy(F.date_add(F.to_date("ts"), 1).cast("timestamp").alias("start")).agg(
        F.avg(error).alias("global_risk")
    )


def trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with both ends: supplier nation to customer nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    sellers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("s_nationkey").alias("seller_nation"), F.col("n_name").alias("seller_name")
    )
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_nationkey").alias("import_nation"), F.col("n_name").alias("import_name")
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense graph of nations; hardship is the lane's line count modulo 20."""
    volume = trade_lines(spark, sf_dir).where("seller_nation <> import_nation").groupBy(
        F.col("seller_name").alias("src"), F.col("import_name").alias("dst")
    )
    return volume.agg((F.count(F.lit(1)) % 20).cast("int").alias("hardship"))


def lane_features(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Requests and their feature tables, ready for the batch analysis."""
    events = table(spark, sf_dir, "events")
    # derived once: every feature table and the assembly start from the requests
    asked = cut_lineage(requests(events))
    trade = trade_signals(shipments(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")))
    return {
        "requests": asked,
        # all request times are midnights: mentions are added up per day first
        "news": news_features(asked, mentions(events), grain="day"),
        "weather": weather_anomaly(weather_rows(asked, events), ["request_id"]),
        "trade": attach_by_lane(asked, trade),
        "pressure": pressure_days(events),
    }
