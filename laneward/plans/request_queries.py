"""The analysis from requests over the warehouse: every order asks about its lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneward.operators.locate import geocode_lookup
from laneward.plans import analyze as analysis
from laneward.plans import warehouse as wh
from laneward.plans.from_requests import analyze_requests as from_requests
from laneward.plans.place_queries import GAZETTEER_SQL, PLACE_NAMES, _place_of
from laneward.plans.registry import query
from laneward.plans.score_queries import LABEL, NORM, SCORED

RAW = f"""
asked AS (
  SELECT o_orderkey AS request_id, o_custkey, o_orderdate AS created_at, o_orderpriority AS component_type,
         CASE WHEN n_nationkey % 5 = 4 THEN n_name ELSE p.name || ', ' || n_name END AS seller_location,
         'Port of ' || p.name AS import_location, CASE WHEN o_orderstatus = 'F' THEN c_name END AS seller_name,
         n_nationkey, o_orderstatus, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN {PLACE_NAMES} ON p.priority = n_nationkey + 1),
known AS (
  SELECT t, min(priority) AS n FROM (SELECT DISTINCT seller_location AS t FROM asked)
  JOIN {GAZETTEER_SQL} ON contains(lower(t), key) OR contains(key, lower(t)) GROUP BY 1),
located AS (
  SELECT a.*, coalesce(g.lat, 0.0) AS lat, coalesce(g.lon, 0.0) AS lon
  FROM asked a LEFT JOIN known ON t = seller_location LEFT JOIN {GAZETTEER_SQL} ON g.priority = known.n),
places AS (SELECT lat, lon, min(n_nationkey) AS n FROM located GROUP BY 1, 2),
sourced AS (
  SELECT *, min(request_id) OVER (PARTITION BY component_type, seller_location, import_location, coalesce(seller_name, ''), created_at) AS source
  FROM located),
raw AS (
  SELECT request_id, component_type || '|' || seller_location || '|' || import_location || '|' || coalesce(seller_name, '') AS lane,
         CAST(created_at AS DATE) AS day, created_at,
         CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) / 5000 ELSE 30.0 END AS inventory_days,
         CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 5.0 END AS past_delay_days,
         CAST(source % 9 AS DOUBLE) AS news_vol_7d, (source % 5) / 10.0 AS neg_tone_frac_3d,
         CAST(CASE WHEN source % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS strike_flag_7d,
         CAST(CASE WHEN p.n % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS weather_anomaly_7d,
         (request_id % 10) / 10.0 AS global_risk,
         component_type, seller_location, seller_name
  FROM sourced JOIN places p USING (lat, lon) WHERE NOT (o_orderstatus = 'P' AND request_id % 2 = 0))"""


@query(f"""
WITH {RAW}, {NORM}, {SCORED}
SELECT s.request_id, component_type, seller_location, coalesce(seller_name, '') AS seller_name,
       round(s.news_vol_7d, 4) AS news_vol_7d, round(s.weather_anomaly_7d, 4) AS weather_anomaly_7d,
       round(risk_score, 4) AS risk_score, {LABEL.format(x='risk_score')} AS risk_label, 7 AS n_factors
FROM scored s JOIN raw USING (request_id)""")
def analyze_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests with answers of all kinds; the nested report is opened again for the check."""
    orders, customer, nation = (wh.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    place = _place_of("n_nationkey")
    asked = rows.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderpriority").alias("component_type"),
        F.when(F.col("n_nationkey") % 5 == 4, F.col("n_name")).otherwise(F.concat(place, F.lit(", "), "n_name")).alias("seller_location"),
        F.concat(F.lit("Port of "), place).alias("import_location"),
        F.when(F.col("o_orderstatus") == "F", F.col("c_name")).alias("seller_name"),
        "n_nationkey",
    )
    key = F.col("o_orderkey")
    trade = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit('```json\n{"past_delay_days":2,"inventory_days":'), (F.floor("o_totalprice") / 5000).cast("string"), F.lit("}\n```")),
        )
        .when((F.col("o_orderstatus") == "P") & (key % 2 == 0), '{"edges":null}')
        .otherwise("no answer")
    )
    news = F.to_json(
        F.struct(
            (key % 9).alias("news_vol_7d"), ((key % 5) / 10).alias("neg_tone_frac_3d"),
            F.when(key % 4 == 0, 1).otherwise(0).alias("strike_flag_7d"),
        )
    )
    answers = orders.select(
        key.alias("request_id"), trade.alias("trade"), news.alias("news"), F.lit("{}").alias("political"),
        F.to_json(F.struct(((key % 10) / 10).alias("global_risk"))).alias("pressure"),
    )
    zero = F.lit(0.0)
    spots = (
        geocode_lookup(asked.select("seller_location", "n_nationkey").distinct(), "seller_location")
        .groupBy(F.coalesce("lat", zero).alias("lat"), F.coalesce("lon", zero).alias("lon"))
        .agg(F.min("n_nationkey").alias("n"))
    )
    days = [F.col("n") + k / 10 for k in range(6)] + [F.when(F.col("n") % 3 == 0, F.col("n") + 40).otherwise(F.col("n") + 0.6)]
    daily = F.array(*[F.struct(F.struct(d.alias("day")).alias("temp")) for d in days])
    weather = spots.select("lat", "lon", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))
    scored, _ = from_requests(asked.drop("n_nationkey"), answers, weather, "2024-01")
    shown = analysis.reports(scored)
    return shown.select(
        "request_id", "inputs.component_type", "inputs.seller_location", F.coalesce("inputs.seller_name", F.lit("")).alias("seller_name"),
        F.round(F.col("features")["news_vol_7d"], 4).alias("news_vol_7d"),
        F.round(F.col("features")["weather_anomaly_7d"], 4).alias("weather_anomaly_7d"),
        F.round("result.risk_score", 4).alias("risk_score"), "result.risk_label", F.size("concise").alias("n_factors"),
    )
