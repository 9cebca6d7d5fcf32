"""Queries of the scoring core: features, normaliser, weights, reports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneward.dims import FEATURES, MITIGATION, ROUTE_OPTIONS
from laneward.functions.risk import clip01, factor_percent, risk_label, squash
from laneward.operators.assemble import assemble_raw, attach_by_lane, attach_pressure, pressure_periods
from laneward.operators.features import (
    stock_days,
    asof_features,
    news_features,
    trade_flow,
    trade_signals,
    trade_totals,
    weather_anomaly,
)
from laneward.operators.model import score_with
from laneward.operators.normalize import normalize_running
from laneward.operators.overview import active_alerts, overview_kpis, risk_trend
from laneward.operators.reuse import reuse_features
from laneward.operators.scoring import (
    DEFAULT_SPECS,
    FeatureSpec,
    factor_impact,
    factor_names,
    factor_rows,
    mitigation,
    rank_factors,
    risk_score,
    risk_score_from_long,
    route_options as route_rows,
    score_points,
    weighted_contrib as contributions,
    with_factors,
)
from laneward.operators.stats import feature_stats as stats, merge_stats as merged, stats_long
from laneward.plans import analyze as analysis
from laneward.plans import warehouse as wh
from laneward.session import cut_lineage
from laneward.plans.registry import query, r6
from laneward.session import shared_folder
from laneward.sources.requests import write_reports
from laneward.sources.state import load_state, save_state

NAMES = [f[0] for f in FEATURES]

# ---------------------------------------------------------------------------
# SQL of the shared inputs
# ---------------------------------------------------------------------------

REQUESTS = """
requests AS (
  SELECT DISTINCT user_id * 100000 + (CAST(ts AS DATE) - DATE '1970-01-01') AS request_id,
         user_id AS lane, CAST(ts AS DATE) AS day,
         CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS created_at
  FROM events)"""
NEWS = """
mentions AS (
  SELECT user_id AS lane, event_id, ts, event_type = 'error' AS negative,
         event_type = 'error' AND value > 150.0 AS strike
  FROM events WHERE event_type <> 'signup'),
news AS (
  SELECT r.request_id,
         CAST(count(m.event_id) AS INTEGER) AS news_vol_7d,
         coalesce(avg(CASE WHEN m.ts > r.created_at - INTERVAL 3 DAY
                           THEN CAST(m.negative AS DOUBLE) END), 0.0) AS neg_tone_frac_3d,
         CAST(coalesce(max(CAST(m.strike AS INTEGER)), 0) AS INTEGER) AS strike_flag_7d
  FROM requests r LEFT JOIN mentions m
    ON m.lane = r.lane AND m.ts > r.created_at - INTERVAL 7 DAY AND m.ts <= r.created_at
  GROUP BY r.request_id)"""
WEATHER = """
daily AS (SELECT user_id AS lane, CAST(ts AS DATE) AS day, avg(value) AS temp FROM events GROUP BY 1, 2),
weather AS (
  SELECT request_id,
         CAST(CASE WHEN count(*) >= 5 AND
                power(greatest(max(temp) - avg(temp), avg(temp) - min(temp)), 2)
                  > 2.25 * var_pop(temp) * (1 + 1e-9)
              THEN 1 ELSE 0 END AS INTEGER) AS weather_anomaly_7d
  FROM requests r JOIN daily d ON d.lane = r.lane AND d.day BETWEEN r.day - 6 AND r.day
  GROUP BY request_id)"""
TRADE = """
trade AS (
  SELECT o_custkey AS lane, avg(l_quantity) AS inventory_days,
         avg(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0)) AS past_delay_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""
PRESSURE = """
pressure AS (
  SELECT CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS start,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS global_risk
  FROM events GROUP BY 1)"""
RAW = """
raw AS (
  SELECT r.request_id, r.lane, r.day, r.created_at,
         coalesce(t.inventory_days, 30.0) AS inventory_days,
         coalesce(t.past_delay_days, 5.0) AS past_delay_days,
         CAST(coalesce(n.news_vol_7d, 0) AS DOUBLE) AS news_vol_7d,
         coalesce(n.neg_tone_frac_3d, 0.0) AS neg_tone_frac_3d,
         CAST(coalesce(n.strike_flag_7d, 0) AS DOUBLE) AS strike_flag_7d,
         CAST(coalesce(w.weather_anomaly_7d, 0) AS DOUBLE) AS weather_anomaly_7d,
         coalesce((SELECT max_by(p.global_risk, p.start) FROM pressure p WHERE p.start <= r.created_at), 0.2)
           AS global_risk
  FROM requests r LEFT JOIN trade t ON t.lane = r.lane
    LEFT JOIN news n ON n.request_id = r.request_id
    LEFT JOIN weather w ON w.request_id = r.request_id)"""
INPUTS = ",".join([REQUESTS, NEWS, WEATHER, TRADE, PRESSURE, RAW])


def _norm_sql(names: list[str], window: str = "w") -> str:
    return ",\n".join(
        f"""CASE WHEN {f} IS NULL THEN NULL WHEN count({f}) OVER {window} < 2 THEN 0.5
      ELSE 1 / (1 + exp(-(({f} - avg({f}) OVER {window}) /
        sqrt(greatest(var_samp({f}) OVER {window}, 1e-12))))) END AS {f}"""
        for f in names
    )


RUNNING = "WINDOW w AS (ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NORM = f"norm AS (SELECT request_id, lane, day, created_at, {_norm_sql(NAMES)} FROM raw {RUNNING})"


def _score_sql(weights: list[tuple[str, float]]) -> str:
    return "least(greatest(" + " + ".join(f"{w!r} * coalesce({f}, 0.5)" for f, w in weights) + ", 0.0), 1.0)"


WEIGHTS = [(f[0], f[1]) for f in FEATURES]
LABEL = "CASE WHEN {x} >= 0.66 THEN 'High' WHEN {x} >= 0.33 THEN 'Medium' ELSE 'Low' END"
SCORED = f"scored AS (SELECT *, {_score_sql(WEIGHTS)} AS risk_score FROM norm)"


def _long_sql(source: str, weights: list[tuple[str, float]]) -> str:
    total = sum(w for _, w in weights)
    return " UNION ALL ".join(
        f"SELECT request_id, {n} AS ordinal, '{f}' AS feature, {w!r} AS weight, coalesce({f}, 0.5) AS value,"
        f" {w!r} * coalesce({f}, 0.5) / {total!r} AS share FROM {source}"
        for n, (f, w) in enumerate(weights, 1)
    )


def _factors_sql(source: str, weights: list[tuple[str, float]]) -> str:
    return f"""contrib AS ({_long_sql(source, weights)}),
factors AS (
  SELECT request_id, ordinal, feature AS name, {LABEL.format(x="share")} AS level, round(share * 100, 2) AS percent,
         row_number() OVER (PARTITION BY request_id ORDER BY round(share * 100, 2) DESC, ordinal) AS rank
  FROM contrib)"""


# ---------------------------------------------------------------------------
# Features from tables
# ---------------------------------------------------------------------------


@query(f"WITH {REQUESTS}, {NEWS} SELECT request_id, news_vol_7d, round(neg_tone_frac_3d, 6) AS neg_tone_frac_3d, strike_flag_7d FROM news")
def news_features_daily(spark: SparkSession, sf: str) -> DataFrame:
    events = wh.table(spark, sf, "events")
    feats = news_features(wh.requests(events), wh.mentions(events), grain="day")
    return feats.withColumn("neg_tone_frac_3d", r6("neg_tone_frac_3d"))


@query(f"""
WITH requests AS (
  SELECT event_id AS request_id, user_id AS lane, ts AS created_at FROM events WHERE event_type = 'purchase'), {NEWS}
SELECT request_id, news_vol_7d, round(neg_tone_frac_3d, 6) AS neg_tone_frac_3d, strike_flag_7d FROM news""")
def news_features_any_time(spark: SparkSession, sf: str) -> DataFrame:
    """Requests at arbitrary times: every purchase asks about its lane."""
    events = wh.table(spark, sf, "events")
    asked = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("lane"), F.col("ts").cast("timestamp").alias("created_at")
    )
    return news_features(asked, wh.mentions(events)).withColumn("neg_tone_frac_3d", r6("neg_tone_frac_3d"))


@query(f"""
WITH {REQUESTS}, sightings AS (
  SELECT user_id AS lane, event_id % 37 AS mention_id, ts, event_type = 'error' AS negative,
         event_type = 'error' AND value > 150.0 AS strike
  FROM events WHERE event_type <> 'signup'),
counted AS (
  SELECT r.request_id, count(DISTINCT m.mention_id) AS n,
         count(DISTINCT CASE WHEN m.ts > r.created_at - INTERVAL 3 DAY THEN m.mention_id END) AS recent,
         count(DISTINCT CASE WHEN m.ts > r.created_at - INTERVAL 3 DAY AND m.negative THEN m.mention_id END) AS bad,
         coalesce(max(CAST(m.strike AS INTEGER)), 0) AS strike
  FROM requests r LEFT JOIN sightings m
    ON m.lane = r.lane AND m.ts > r.created_at - INTERVAL 7 DAY AND m.ts <= r.created_at
  GROUP BY r.request_id)
SELECT request_id, CAST(n AS INTEGER) AS news_vol_7d,
       round(CASE WHEN recent > 0 THEN bad / recent ELSE 0.0 END, 6) AS neg_tone_frac_3d,
       CAST(strike AS INTEGER) AS strike_flag_7d
FROM counted""")
def news_features_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that are seen again, days apart: each counts once in a window."""
    events = wh.table(spark, sf, "events")
    again = wh.mentions(events).withColumn("mention_id", F.col("mention_id") % 37)
    feats = news_features(wh.requests(events), again, grain="day")
    return feats.withColumn("neg_tone_frac_3d", r6("neg_tone_frac_3d"))


@query("""
WITH months AS (
  SELECT strftime(ts, '%Y-%m') AS month, CASE WHEN month(min(ts)) % 3 > 0 THEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) END AS risk
  FROM events GROUP BY 1),
known AS (SELECT strptime(month || '-01', '%Y-%m-%d') AS start, risk FROM months WHERE risk IS NOT NULL)
SELECT o_orderkey AS request_id, round((SELECT max_by(k.risk, k.start) FROM known k WHERE k.start <= o_orderdate), 6) AS global_risk
FROM orders""")
def pressure_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A month-keyed index with months that have no value and one that is no month."""
    error = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    months = wh.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.when(F.month(F.min("ts")) % 3 > 0, error).alias("global_risk")
    )
    bad = spark.createDataFrame([("soon", 1.0)], "month string, global_risk double")
    orders = wh.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"))
    risk = attach_pressure(orders, pressure_periods(months.unionByName(bad)))
    return risk.select("request_id", r6("global_risk").alias("global_risk"))


@query(f"WITH {REQUESTS}, {WEATHER} SELECT request_id, weather_anomaly_7d FROM weather")
def weather_anomaly_days(spark: SparkSession, sf: str) -> DataFrame:
    events = wh.table(spark, sf, "events")
    return weather_anomaly(wh.weather_rows(wh.requests(events), events), ["request_id"])


@query(f"WITH {TRADE} SELECT lane, round(inventory_days, 6) AS inventory_days, round(past_delay_days, 6) AS past_delay_days FROM trade")
def trade_signals_by_lane(spark: SparkSession, sf: str) -> DataFrame:
    lines = wh.shipments(wh.table(spark, sf, "orders"), wh.table(spark, sf, "lineitem"))
    return trade_signals(lines).withColumns({c: r6(c) for c in ("inventory_days", "past_delay_days")})


@query("""
WITH moves AS (
  SELECT s_nationkey AS lane, CAST(o_orderdate AS DATE) AS day, l_quantity AS inflow, 0.0 AS outflow
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT s_nationkey, CAST(l_shipdate AS DATE), 0.0, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
daily AS (SELECT lane, day, sum(inflow) AS inflow, sum(outflow) AS outflow FROM moves GROUP BY 1, 2),
summed AS (
  SELECT lane, day,
    sum(inflow - outflow) OVER (PARTITION BY lane ORDER BY day) AS stock,
    sum(outflow) OVER (PARTITION BY lane ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
      / least(30, day - min(day) OVER (PARTITION BY lane) + 1) AS daily_outflow
  FROM daily)
SELECT lane, strftime(day, '%Y-%m-%d') AS day, round(stock, 6) AS stock, round(daily_outflow, 6) AS daily_outflow,
  round(CASE WHEN daily_outflow <> 0 THEN greatest(stock, 0.0) / daily_outflow END, 6) AS stock_days
FROM summed""")
def stock_days_by_lane(spark: SparkSession, sf: str) -> DataFrame:
    """Goods enter a supplier nation's stock when they are ordered and leave it when they are shipped."""
    supplier = wh.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("lane"))
    orders = wh.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = wh.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    none = F.lit(0.0)
    came = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "lane", F.to_date("o_orderdate").alias("day"), F.col("l_quantity").alias("inflow"), none.alias("outflow")
    )
    went = lines.select("lane", F.to_date("l_shipdate").alias("day"), none.alias("inflow"), F.col("l_quantity").alias("outflow"))
    found = stock_days(came.unionByName(went))
    return found.select("lane", F.date_format("day", "yyyy-MM-dd").alias("day"), *[r6(c).alias(c) for c in ("stock", "daily_outflow", "stock_days")])


EDGE_LINES = """
lines AS (
  SELECT sn.n_name AS exporter, cn.n_name AS importer, l_extendedprice AS trade_value_usd,
         strftime(l_shipdate, '%Y-%m') AS month
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"""


def _trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    return wh.trade_lines(spark, sf).select(
        F.col("seller_name").alias("exporter"),
        F.col("import_name").alias("importer"),
        F.col("l_extendedprice").alias("trade_value_usd"),
        F.date_format("l_shipdate", "yyyy-MM").alias("timestamp"),
    )


@query(f"""
WITH {EDGE_LINES}, monthly AS (
  SELECT exporter, importer, month, sum(trade_value_usd) AS v FROM lines GROUP BY ALL),
flow AS (
  SELECT *, avg(v) OVER (PARTITION BY exporter, importer ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b
  FROM monthly)
SELECT exporter, importer, month, round(v, 2) AS value_usd, round(b, 4) AS baseline_usd, round(v / b, 6) AS ratio FROM flow""")
def trade_flow_monthly(spark: SparkSession, sf: str) -> DataFrame:
    flow = trade_flow(_trade_edges(spark, sf))
    return flow.withColumns(
        {"value_usd": F.round("value_usd", 2), "baseline_usd": F.round("baseline_usd", 4), "ratio": r6("ratio")}
    )


@query(f"""
WITH {EDGE_LINES}
SELECT exporter, month, round(sum(trade_value_usd), 2) AS value_usd, count(*) AS n_edges FROM lines GROUP BY ROLLUP (exporter, month)""")
def trade_totals_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return trade_totals(_trade_edges(spark, sf)).withColumn("value_usd", F.round("value_usd", 2))


@query(f"""
WITH {INPUTS}
SELECT request_id, {', '.join(f'round({f}, 6) AS {f}' for f in NAMES)} FROM raw""")
def assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    t = wh.lane_features(spark, sf)
    asked = attach_pressure(t["requests"], t["pressure"])
    raw = assemble_raw(asked, [t["trade"], t["news"], t["weather"]])
    return raw.select("request_id", *[r6(f).alias(f) for f in NAMES])


# ---------------------------------------------------------------------------
# Reuse and as-of lookup: a lane is the nation of the customer
# ---------------------------------------------------------------------------


def _nation_requests(spark: SparkSession, sf: str) -> DataFrame:
    events = wh.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    customer = wh.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return events.join(customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("request_id"),
        F.col("c_nationkey").alias("lane"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "event_type",
        "value",
    )


NATION_REQUESTS = """
req AS (SELECT event_id AS request_id, c_nationkey AS lane, ts AS created_at, event_type, value
        FROM events JOIN customer ON user_id = c_custkey)"""


@query(f"""
WITH RECURSIVE {NATION_REQUESTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY created_at, request_id) AS n FROM req),
chain AS (
  SELECT lane, n, request_id, request_id AS source_request_id, created_at AS anchor FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.lane, x.n, x.request_id,
         CASE WHEN x.created_at - c.anchor >= INTERVAL 15 MINUTE THEN x.request_id ELSE c.source_request_id END,
         CASE WHEN x.created_at - c.anchor >= INTERVAL 15 MINUTE THEN x.created_at ELSE c.anchor END
  FROM chain c JOIN numbered x ON x.lane = c.lane AND x.n = c.n + 1)
SELECT lane, request_id, source_request_id, request_id <> source_request_id AS is_reuse FROM chain""")
def reuse_within_15_minutes(spark: SparkSession, sf: str) -> DataFrame:
    reused = reuse_features(_nation_requests(spark, sf))
    return reused.select("lane", "request_id", "source_request_id", "is_reuse")


@query(f"""
WITH {NATION_REQUESTS},
feats AS (SELECT lane, created_at AS computed_at, max_by(value, request_id) AS value
          FROM req WHERE event_type = 'view' GROUP BY 1, 2)
SELECT q.request_id, q.lane, CASE WHEN q.created_at - f.computed_at < INTERVAL 15 MINUTE THEN f.value END AS value
FROM (SELECT * FROM req WHERE event_type <> 'view') q
ASOF LEFT JOIN feats f ON f.lane = q.lane AND f.computed_at <= q.created_at""")
def asof_feature_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Views are computed feature rows; all other events ask for one."""
    rows = _nation_requests(spark, sf)
    feats = rows.where("event_type = 'view'").groupBy("lane", F.col("created_at").alias("computed_at")).agg(
        F.max_by("value", "request_id").alias("value")
    )
    asked = rows.where("event_type <> 'view'").select("request_id", "lane", "created_at")
    return asof_features(asked, feats).select("request_id", "lane", "value")


# ---------------------------------------------------------------------------
# Statistics and normaliser
# ---------------------------------------------------------------------------


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    t = wh.lane_features(spark, sf)
    return assemble_raw(attach_pressure(t["requests"], t["pressure"]), [t["trade"], t["news"], t["weather"]])


STATS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(count({c}) AS DOUBLE) AS \"count\", round(avg({c}), 4) AS mean,"
    f" round(var_pop({c}), 6) AS var_pop FROM lineitem"
    for f, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax"))
)


def _stats_frame(spark: SparkSession, sf: str) -> DataFrame:
    return wh.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        "l_returnflag",
    )


def _shown(state: DataFrame) -> DataFrame:
    return state.select("feature", "count", F.round("mean", 4).alias("mean"), r6(F.col("M2") / F.col("count")).alias("var_pop"))


@query(STATS)
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(stats(_stats_frame(spark, sf), ["quantity", "discount", "tax"]))


@query(STATS)
def merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics per return flag, merged into those of the whole table."""
    lines = _stats_frame(spark, sf)
    return _shown(merged(stats_long(lines, ["l_returnflag"], ["quantity", "discount", "tax"]).drop("l_returnflag")))


@query(STATS)
def state_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """State written as two versions to the shared folder and loaded again."""
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    lines, names = _stats_frame(spark, sf), ["quantity", "discount", "tax"]
    save_state(stats(lines.where("l_returnflag = 'A'"), names), path)
    rest = stats(lines.where("l_returnflag <> 'A'"), names)
    save_state(merged(load_state(spark, path), rest), path)
    return _shown(load_state(spark, path))


@query(f"""
WITH lanes AS (
  SELECT o_custkey AS lane, c_nationkey AS nation, avg(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
groups AS (SELECT nation, count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM lanes GROUP BY 1)
SELECT lane, round(CASE WHEN n < 2 THEN 0.5
  ELSE 1 / (1 + exp(-((v - mean) / sqrt(greatest(var, 1e-12))))) END, 6) AS squashed
FROM lanes JOIN groups USING (nation)""")
def squash_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value of each customer against the customers of its nation."""
    orders = wh.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lane")).agg(F.avg("o_totalprice").alias("v"))
    customer = wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("lane"), F.col("c_nationkey").alias("nation"))
    lanes = orders.join(customer, "lane")
    groups = lanes.groupBy("nation").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")
    )
    return lanes.join(groups, "nation").select(
        "lane", r6(squash(F.col("v"), F.col("n"), F.col("mean"), F.col("m2"))).alias("squashed")
    )


NORM_SHOWN = f"SELECT request_id, {', '.join(f'round({f}, 6) AS {f}' for f in NAMES)} FROM norm"


@query(f"WITH {INPUTS}, {NORM} {NORM_SHOWN}")
def normalize_requests(spark: SparkSession, sf: str) -> DataFrame:
    norm = normalize_running(cut_lineage(_raw(spark, sf)), NAMES)
    return norm.select("request_id", *[r6(f).alias(f) for f in NAMES])


@query(f"""
WITH prices AS (SELECT o_orderkey AS request_id, o_orderdate AS created_at, o_totalprice AS price FROM orders)
SELECT request_id, round(x, 6) AS price FROM (
  SELECT request_id, {_norm_sql(['price']).replace(' AS price', ' AS x')} FROM prices {RUNNING})""")
def normalize_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's value against all orders before it; days hold many orders."""
    raw = wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price")
    )
    return normalize_running(raw, ["price"]).select("request_id", r6("price").alias("price"))


@query(f"""
WITH lines AS (SELECT o_orderkey AS request_id, o_custkey, o_orderdate AS created_at, o_totalprice AS price FROM orders)
SELECT request_id, round(x, 6) AS price FROM (
  SELECT request_id, {_norm_sql(['price']).replace(' AS price', ' AS x')} FROM lines
  WINDOW w AS (PARTITION BY o_custkey ORDER BY created_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def normalize_per_lane(spark: SparkSession, sf: str) -> DataFrame:
    """The scoped form: each order against the earlier ones of its customer."""
    raw = wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), "o_custkey", F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price")
    )
    return normalize_running(raw, ["price"], scope=["o_custkey"]).select("request_id", r6("price").alias("price"))


@query(f"""
WITH prices AS (SELECT o_orderkey AS request_id, o_orderdate AS created_at, o_totalprice AS price FROM orders)
SELECT request_id, round(x, 6) AS price FROM (
  SELECT request_id, created_at, {_norm_sql(['price']).replace(' AS price', ' AS x')} FROM prices {RUNNING})
WHERE created_at >= TIMESTAMP '1998-01-01'""")
def normalize_from_state(spark: SparkSession, sf: str) -> DataFrame:
    """Later orders, continued from the saved statistics of the earlier ones."""
    raw = wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price")
    )
    cut = F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
    state = stats(raw.where(~cut), ["price"])
    later = normalize_running(raw.where(cut), ["price"], state=state)
    return later.select("request_id", r6("price").alias("price"))


# ---------------------------------------------------------------------------
# Scoring rules, over orders as already normalised requests
# ---------------------------------------------------------------------------

ORDER_VALUES = """
vals AS (
  SELECT o_orderkey AS request_id,
         o_totalprice / 499999 AS inventory_days,
         dayofyear(o_orderdate) / 366 AS past_delay_days,
         month(o_orderdate) / 12 AS news_vol_7d,
         day(o_orderdate) / 31 AS neg_tone_frac_3d,
         CASE o_orderstatus WHEN 'P' THEN 1.0 WHEN 'O' THEN 0.0 END AS strike_flag_7d,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 5 AS weather_anomaly_7d,
         CAST(NULL AS DOUBLE) AS global_risk
  FROM orders)"""
ORDER_SCORED = f"scored AS (SELECT *, {_score_sql(WEIGHTS)} AS risk_score FROM vals)"


def order_values(spark: SparkSession, sf: str) -> DataFrame:
    """Six value columns per order; global_risk is missing, strike often null."""
    return wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_totalprice") / 499999).alias("inventory_days"),
        (F.dayofyear("o_orderdate") / 366).alias("past_delay_days"),
        (F.month("o_orderdate") / 12).alias("news_vol_7d"),
        (F.dayofmonth("o_orderdate") / 31).alias("neg_tone_frac_3d"),
        F.when(F.col("o_orderstatus") == "P", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("strike_flag_7d"),
        (F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("weather_anomaly_7d"),
    )


@query(f"""
WITH {ORDER_VALUES}, contrib AS ({_long_sql('vals', WEIGHTS)})
SELECT request_id, CAST(ordinal AS INTEGER) AS ordinal, feature, CAST(weight AS DOUBLE) AS weight,
       round(value, 6) AS value, round(share, 6) AS share FROM contrib""")
def weighted_contrib(spark: SparkSession, sf: str) -> DataFrame:
    return contributions(order_values(spark, sf)).withColumns({"value": r6("value"), "share": r6("share")})


SCORE_SHOWN = f"SELECT request_id, round(risk_score, 6) AS risk_score, {LABEL.format(x='risk_score')} AS risk_label FROM scored"


@query(f"WITH {ORDER_VALUES}, {ORDER_SCORED} {SCORE_SHOWN}")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return risk_score(order_values(spark, sf)).select("request_id", r6("risk_score").alias("risk_score"), "risk_label")


@query(f"WITH {ORDER_VALUES}, {ORDER_SCORED} SELECT request_id, round(risk_score, 6) AS risk_score FROM scored")
def risk_scores_long(spark: SparkSession, sf: str) -> DataFrame:
    long = contributions(order_values(spark, sf))
    return risk_score_from_long(long).withColumn("risk_score", r6("risk_score"))


@query(f"""
SELECT o_orderkey AS request_id, round(least(greatest(o_totalprice / 399999 - 0.1, 0.0), 1.0), 6) AS score,
       {LABEL.format(x="least(greatest(o_totalprice / 399999 - 0.1, 0.0), 1.0)")} AS label,
       round(least(greatest(o_totalprice / 399999 - 0.1, 0.0), 1.0) * 100, 2) AS percent
FROM orders""")
def clip_label_percent(spark: SparkSession, sf: str) -> DataFrame:
    score = clip01(F.col("o_totalprice") / 399999 - 0.1)
    return wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        r6(score).alias("score"),
        risk_label(score).alias("label"),
        factor_percent(score).alias("percent"),
    )


IMPACT = "CASE name " + " ".join(f"WHEN '{f}' THEN '{text}'" for f, _, _, text in FEATURES) + " ELSE 'Contributing risk factor' END"
ORDER_FACTORS = f"{ORDER_VALUES}, {_factors_sql('vals', WEIGHTS)}"


@query(f"""
WITH {ORDER_FACTORS}
SELECT request_id, CAST(rank AS INTEGER) AS rank, name, level, percent, {IMPACT} AS impact FROM factors""")
def ranked_factors(spark: SparkSession, sf: str) -> DataFrame:
    return factor_rows(with_factors(order_values(spark, sf)))


@query(f"WITH {ORDER_FACTORS} SELECT request_id, name, percent, CAST(rank AS INTEGER) AS rank FROM factors")
def rank_factor_table(spark: SparkSession, sf: str) -> DataFrame:
    """Factor rows that arrive as a table, ranked by a window."""
    rows = contributions(order_values(spark, sf)).select(
        "request_id", "ordinal", F.col("feature").alias("name"), factor_percent(F.col("share")).alias("percent")
    )
    return rank_factors(rows).select("request_id", "name", "percent", "rank")


@query(f"""
WITH {ORDER_FACTORS}
SELECT name, count(*) AS n, {IMPACT} AS impact FROM factors GROUP BY name
UNION ALL SELECT 'mode_' || l_linestatus, count(*), 'Contributing risk factor' FROM lineitem GROUP BY 1""")
def factor_impacts(spark: SparkSession, sf: str) -> DataFrame:
    known = contributions(order_values(spark, sf)).groupBy(F.col("feature").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    other = wh.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("mode_"), "l_linestatus").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return factor_impact(known.unionByName(other))


@query("""
SELECT DISTINCT name, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '),
         lambda x: upper(x[1]) || x[2:]), ' ') AS display_name,
       CASE WHEN contains(name, 'weather') THEN 'weather' WHEN contains(name, 'strike') THEN 'strike'
            WHEN contains(name, 'political') THEN 'political' WHEN contains(name, 'sanctions') THEN 'sanctions'
            ELSE 'other' END AS category
FROM (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'strike' WHEN 'view' THEN 'weather' WHEN 'click' THEN 'political'
                          WHEN 'signup' THEN 'sanctions' ELSE event_type END || '_flag_' || c_nationkey || 'd' AS name
      FROM events JOIN customer ON user_id = c_custkey)""")
def factor_display(spark: SparkSession, sf: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "error", "strike")
        .when(F.col("event_type") == "view", "weather")
        .when(F.col("event_type") == "click", "political")
        .when(F.col("event_type") == "signup", "sanctions")
        .otherwise(F.col("event_type"))
    )
    rows = _nation_requests(spark, sf).select(F.concat(kind, F.lit("_flag_"), "lane", F.lit("d")).alias("name")).distinct()
    return factor_names(rows)


@query(f"""
WITH {ORDER_VALUES}, {ORDER_SCORED}
SELECT request_id, CAST(round(risk_score * 100) AS INTEGER) AS score_100,
       CAST(round((1 - risk_score) * 100) AS INTEGER) AS reliability FROM scored""")
def score_out_of_100(spark: SparkSession, sf: str) -> DataFrame:
    return score_points(risk_score(order_values(spark, sf))).select("request_id", "score_100", "reliability")


def _option_sql(n: int, name: str, cut: float | None, points: int, duration: str, cost: str) -> str:
    risk = LABEL.format(x="risk_score") if cut is None else f"CASE WHEN risk_score > {cut} THEN 'High' ELSE 'Medium' END"
    return (
        f"SELECT request_id, {n} AS route_no, '{name}' AS name, {risk} AS risk, '{duration}' AS duration, '{cost}' AS cost,"
        f" CAST(round((1 - risk_score) * 100) AS INTEGER) - {points} AS reliability FROM scored"
    )


@query(f"WITH {ORDER_VALUES}, {ORDER_SCORED} " + " UNION ALL ".join(_option_sql(n, *o) for n, o in enumerate(ROUTE_OPTIONS, 1)))
def route_options(spark: SparkSession, sf: str) -> DataFrame:
    return route_rows(risk_score(order_values(spark, sf)))


@query(
    "WITH strategies AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in MITIGATION.items())
    + ") AS s(strategy, text)) SELECT o_orderstatus, strategy, text, count(*) AS n_reports"
    " FROM orders, strategies GROUP BY ALL"
)
def mitigation_strategies(spark: SparkSession, sf: str) -> DataFrame:
    rows = mitigation(wh.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))
    listed = rows.select("o_orderstatus", F.explode("mitigation_strategies").alias("strategy", "text"))
    return listed.groupBy("o_orderstatus", "strategy", "text").agg(F.count(F.lit(1)).alias("n_reports"))


# ---------------------------------------------------------------------------
# End to end
# ---------------------------------------------------------------------------


def _analyzed(spark: SparkSession, sf: str, weights=None) -> DataFrame:
    t = wh.lane_features(spark, sf)
    return analysis.analyze(t["requests"], [t["trade"], t["news"], t["weather"]], t["pressure"], weights)


TOP = "(SELECT name FROM factors f WHERE f.request_id = s.request_id AND rank = {n})"


def _analyze_sql(weights: list[tuple[str, float]], norm: str = NORM) -> str:
    return f"""
WITH {INPUTS}, {norm}, scored AS (SELECT *, {_score_sql(weights)} AS risk_score FROM norm), {_factors_sql('norm', weights)},
top AS (SELECT request_id, string_agg(name || '=' || CAST(percent AS VARCHAR), ', ' ORDER BY rank) AS ranked FROM factors GROUP BY 1)
SELECT s.request_id, s.lane, round(risk_score, 6) AS risk_score, {LABEL.format(x='risk_score')} AS risk_label, ranked
FROM scored s JOIN top USING (request_id)"""


def _analysis_rows(scored: DataFrame) -> DataFrame:
    ranked = F.array_join(
        F.transform("factors", lambda f: F.concat(f["name"], F.lit("="), f["percent"].cast("string"))), ", "
    )
    return scored.select("request_id", "lane", r6("risk_score").alias("risk_score"), "risk_label", ranked.alias("ranked"))


@query(_analyze_sql(WEIGHTS))
def analyze(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every lane-day from raw tables to score, label and ranked factors."""
    return _analysis_rows(_analyzed(spark, sf))


CUSTOM = [("news_vol_7d", 0.5), ("strike_flag_7d", 0.3), ("unknown_feature", 0.4)]


@query(_analyze_sql(CUSTOM, NORM.replace("SELECT request_id,", "SELECT CAST(NULL AS DOUBLE) AS unknown_feature, request_id,", 1)))
def analyze_custom_weights(spark: SparkSession, sf: str) -> DataFrame:
    """A user weight table: two known features and one no request has."""
    known = [(n, f, w) for n, (f, w) in enumerate(CUSTOM, 1)]
    weights = spark.createDataFrame(known, "ordinal int, feature string, weight double")
    t = wh.lane_features(spark, sf)
    raw = assemble_raw(t["requests"], [t["trade"], t["news"], t["weather"]])
    norm = normalize_running(raw, ["news_vol_7d", "strike_flag_7d"])
    return _analysis_rows(with_factors(risk_score(norm, weights), weights))


ADDED = [*WEIGHTS[:6], ("global_risk", 0.03), ("lane_value", 0.02)]
ADDED_RAW = """
added AS (SELECT raw.*, coalesce(v.lane_value, 0.0) AS lane_value FROM raw LEFT JOIN
  (SELECT o_custkey AS lane, avg(o_totalprice) AS lane_value FROM orders GROUP BY 1) v USING (lane))"""


@query(
    _analyze_sql(
        ADDED,
        ADDED_RAW + f", norm AS (SELECT request_id, lane, day, created_at, {_norm_sql([f for f, _ in ADDED])} FROM added {RUNNING})",
    )
)
def analyze_added_feature(spark: SparkSession, sf: str) -> DataFrame:
    """An eighth feature: one more column and one more weight row."""
    specs = [FeatureSpec(s.feature, dict(ADDED)[s.feature], s.default_value, s.impact) for s in DEFAULT_SPECS]
    specs.append(FeatureSpec("lane_value", 0.02))
    t = wh.lane_features(spark, sf)
    value = wh.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lane")).agg(F.avg("o_totalprice").alias("lane_value"))
    extra = attach_by_lane(t["requests"], value)
    scored = analysis.analyze(t["requests"], [t["trade"], t["news"], t["weather"], extra], t["pressure"], specs)
    return _analysis_rows(scored)


@query(f"""
WITH {INPUTS}, {NORM}, {SCORED}
SELECT {LABEL.format(x='risk_score')} AS risk_label, count(*) AS n_reports, CAST(count(*) * 7 AS BIGINT) AS n_factors,
       CAST(count(*) * 3 AS BIGINT) AS n_strategies, round(avg(risk_score), 6) AS mean_score
FROM scored GROUP BY 1""")
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Nested reports written to the shared folder, read back and counted."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(analysis.reports(_analyzed(spark, sf)), path)
    back = spark.read.parquet(path)
    return back.groupBy("result.risk_label").agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.sum(F.size("concise")).alias("n_factors"),
        F.sum(F.size("comprehensive.mitigation_strategies")).alias("n_strategies"),
        r6(F.avg("result.risk_score")).alias("mean_score"),
    )


def mean_model(batch: pd.DataFrame) -> tuple[pd.Series, pd.DataFrame]:
    """An example scorer: the plain mean, with equal contributions."""
    filled = batch.fillna(0.5)
    return filled.mean(axis=1), filled / filled.shape[1]


SIX = NAMES[:6]


@query(f"""
WITH {ORDER_VALUES}
SELECT request_id, round(least(greatest(({' + '.join(f'coalesce({f}, 0.5)' for f in SIX)}) / 6, 0.0), 1.0), 6) AS risk_score,
       round(coalesce(strike_flag_7d, 0.5) / 6, 6) AS strike_part
FROM vals""")
def score_with_model(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_with(order_values(spark, sf), mean_model, SIX)
    return scored.select(
        "request_id",
        r6("risk_score").alias("risk_score"),
        r6(F.col("risk_components")["strike_flag_7d"]).alias("strike_part"),
    )


# ---------------------------------------------------------------------------
# Overview
# ---------------------------------------------------------------------------

AS_OF = "2024-01-30 12:00:00"
SEVERITY = "CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END"


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "medium").otherwise("low")
    return wh.table(spark, sf, "events").select("ts", F.col("event_type").alias("type"), severity.alias("severity"))


ALERTS = f"""
SELECT event_type AS type, {SEVERITY} AS severity, count(*) AS n_alerts FROM events
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2"""


@query(ALERTS)
def alerts_last_24_hours(spark: SparkSession, sf: str) -> DataFrame:
    return active_alerts(_alerts(spark, sf), AS_OF)


def _event_scores(spark: SparkSession, sf: str) -> DataFrame:
    return wh.table(spark, sf, "events").select(F.col("ts").alias("created_at"), (F.col("value") / 500).alias("risk_score"))


TREND = "CASE WHEN {b} IS NULL OR abs({a} - {b}) < 0.005 THEN 'stable' WHEN {a} < {b} THEN 'decreasing' ELSE 'increasing' END"


@query(f"""
WITH means AS (SELECT date_trunc('week', ts) AS p, avg(value / 500) AS m, count(*) AS n FROM events GROUP BY 1),
lagged AS (SELECT *, lag(m) OVER (ORDER BY p) AS b FROM means)
SELECT strftime(p, '%Y-%m-%d') AS period_start, round(m, 6) AS mean_score, n AS n_requests, {TREND.format(a='m', b='b')} AS risk_trend
FROM lagged""")
def risk_trend_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return risk_trend(_event_scores(spark, sf)).withColumns(
        {"period_start": F.date_format("period_start", "yyyy-MM-dd"), "mean_score": r6("mean_score")}
    )


@query(f"""
WITH means AS (
  SELECT avg(CASE WHEN ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN value / 500 END) AS a,
         avg(CASE WHEN ts <= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN value / 500 END) AS b
  FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{AS_OF}')
SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS total_suppliers,
       (SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS active_routes,
       (SELECT CAST(sum(n_alerts) AS BIGINT) FROM ({ALERTS})) AS active_alerts,
       (SELECT round(avg(CASE WHEN l_shipdate <= o_orderdate THEN 100.0 ELSE 0.0 END), 6)
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS reliability_score,
       {TREND.format(a='a', b='b')} AS risk_trend, '{AS_OF}' AS last_updated
FROM means""")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    orders = wh.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = wh.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    kpis = overview_kpis(
        joined.select(F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("lane")),
        _event_scores(spark, sf),
        _alerts(spark, sf),
        joined.select((F.col("l_shipdate") <= F.col("o_orderdate")).alias("on_time")),
        AS_OF,
    )
    return kpis.withColumn("reliability_score", r6("reliability_score"))
