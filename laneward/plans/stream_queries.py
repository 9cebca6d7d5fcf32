"""Streaming queries over the warehouse, each run to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from laneward.plans import warehouse as wh
from laneward.plans import place_queries, score_queries  # noqa: F401 (their SQL is shared)
from laneward.plans.score_queries import NATION_REQUESTS, _norm_sql
from laneward.plans.registry import ORACLE, query, r6
from laneward.session import shared_folder
from laneward.streaming.keyed import normalize_lane_stream, reuse_lane_stream
from laneward.streaming.mentions import news_features_stream
from laneward.streaming.stateful import normalize_stream, reuse_stream


BATCHES, FILES = 5, 2


def _stream(spark: SparkSession, sf: str, name: str, by: str) -> DataFrame:
    """The whole table as a stream of BATCHES slices in order of time, one slice per micro-batch."""
    rows = wh.table(spark, sf, name)
    path = f"{_folder(spark)}/{name}"
    at = F.unix_micros(F.col(by).cast("timestamp"))
    cuts = rows.select(at.cast("double").alias("t")).approxQuantile("t", [k / BATCHES for k in range(1, BATCHES)], 0.001)
    slice_no = sum(((at > F.lit(int(c))).cast("int") for c in cuts), F.lit(0))
    for k in range(BATCHES):
        rows.where(slice_no == k).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _run(writer: DataStreamWriter, folder: str) -> None:
    started = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    started.awaitTermination()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("""
WITH mentions AS (
  SELECT user_id AS lane, event_id, ts, event_type = 'error' AS negative, event_type = 'error' AND value > 150.0 AS strike
  FROM events WHERE event_type <> 'signup'),
ends AS (
  SELECT lane, m.*, CAST(CAST(ts - INTERVAL 1 MICROSECOND AS DATE) + CAST(k AS INTEGER) AS TIMESTAMP) AS as_of
  FROM mentions m, range(1, 8) t(k))
SELECT lane, strftime(as_of, '%Y-%m-%d') AS as_of, CAST(count(*) AS INTEGER) AS news_vol_7d,
       round(coalesce(avg(CASE WHEN ts > as_of - INTERVAL 3 DAY THEN CAST(negative AS DOUBLE) END), 0.0), 6) AS neg_tone_frac_3d,
       CAST(max(CAST(strike AS INTEGER)) AS INTEGER) AS strike_flag_7d
FROM ends
WHERE as_of <= (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 1 DAY FROM mentions)
GROUP BY lane, as_of""".replace("SELECT lane, m.*,", "SELECT m.*,"))
def news_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The closed windows of a one-day watermark."""
    folder = _folder(spark)
    feats = news_features_stream(wh.mentions(_stream(spark, sf, "events", "ts")))
    _run(feats.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
    return spark.read.parquet(f"{folder}/out").select(
        "lane",
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"),
        "news_vol_7d",
        r6("neg_tone_frac_3d").alias("neg_tone_frac_3d"),
        "strike_flag_7d",
    )


@query(ORACLE["normalize_orders"])
def normalize_order_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    raw = _stream(spark, sf, "orders", "o_orderdate").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price")
    )
    _run(normalize_stream(raw, ["price"], f"{folder}/state", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").select("request_id", r6("price").alias("price"))


@query(ORACLE["reuse_within_15_minutes"])
def reuse_request_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    customer = wh.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    asked = _stream(spark, sf, "events", "ts").join(customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("request_id"),
        F.col("c_nationkey").alias("lane"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    _run(reuse_stream(asked, f"{folder}/state", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").select("lane", "request_id", "source_request_id", "is_reuse")


def _closed(time: str, table: str, slice_seconds: int, lateness_seconds: int) -> str:
    """Condition on rows whose slice the watermark at the end of the stream has passed."""
    width = slice_seconds * 1_000_000
    last = f"(SELECT epoch_us(max({time})) - {lateness_seconds * 1_000_000} FROM {table})"
    return f"epoch_us({time}) // {width} < {last} // {width}"


def _emitted(spark: SparkSession, out: DataFrame) -> DataFrame:
    folder = _folder(spark)
    _run(out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
    return spark.read.parquet(f"{folder}/out")


@query(f"""
WITH RECURSIVE {NATION_REQUESTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY created_at, request_id) AS n FROM req),
chain AS (
  SELECT lane, n, request_id, created_at, request_id AS source_request_id, created_at AS anchor FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.lane, x.n, x.request_id, x.created_at,
         CASE WHEN x.created_at - c.anchor >= INTERVAL 15 MINUTE THEN x.request_id ELSE c.source_request_id END,
         CASE WHEN x.created_at - c.anchor >= INTERVAL 15 MINUTE THEN x.created_at ELSE c.anchor END
  FROM chain c JOIN numbered x ON x.lane = c.lane AND x.n = c.n + 1)
SELECT lane, request_id, source_request_id, request_id <> source_request_id AS is_reuse, false AS is_late
FROM chain WHERE {_closed("created_at", "req", 6 * 3600, 900)}""")
def reuse_keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The closed slices of six hours, from one state for each lane."""
    customer = wh.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    asked = _stream(spark, sf, "events", "ts").join(customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("request_id"),
        F.col("c_nationkey").alias("lane"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    out = _emitted(spark, reuse_lane_stream(asked, slice_of="6 hours"))
    return out.select("lane", "request_id", "source_request_id", "is_reuse", "is_late")


@query(f"""
WITH lines AS (
  SELECT o_orderkey AS request_id, c_nationkey, o_orderdate AS created_at, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, request_id, round(x, 6) AS price, false AS is_late FROM (
  SELECT c_nationkey, request_id, created_at, {_norm_sql(['price']).replace(' AS price', ' AS x')} FROM lines
  WINDOW w AS (PARTITION BY c_nationkey ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE {_closed("created_at", "lines", 30 * 86400, 86400)}""")
def normalize_keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Each order against the earlier ones of its nation: the closed slices of thirty days."""
    customer = wh.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    raw = _stream(spark, sf, "orders", "o_orderdate").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"),
        "c_nationkey",
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("price"),
    )
    out = _emitted(spark, normalize_lane_stream(raw, ["price"], scope=["c_nationkey"], slice_of="30 days"))
    return out.select("c_nationkey", "request_id", r6("price").alias("price"), "is_late")
