"""Physical plans: pushdown, joins, windows, and what must not be there."""

import pytest

from __spark_entry__ import queries
from laneward.plans import score_queries as sq
from laneward.plans import warehouse as wh


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


PYTHON_QUERIES = {"score_with_model", "reuse_within_15_minutes"}


@pytest.mark.parametrize(
    "name",
    ["analyze", "normalize_per_lane", "news_features_any_time", "asof_feature_lookup", "route_paths", "lane_routes",
     "geocode_long_gazetteer", "mention_match", "page_text", "weather_flags", "trade_edges_valid", "overview",
     "score_with_model", "reuse_within_15_minutes"],
)
def test_no_nested_loops_and_python_only_where_stated(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    has_python = any(op in text for op in ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython"))
    assert has_python == (name in PYTHON_QUERIES)


@pytest.mark.parametrize("name", ["normalize_orders", "analyze"])
def test_running_window_reuses_the_bucket_placement(spark, sf_dir, name):
    """The window over rows needs no second shuffle and always has a partition key."""
    text = plan(queries()[name](spark, sf_dir))
    assert "shufflepartitionidpassthrough" in text
    for line in text.splitlines():
        if line.startswith("Arguments: [") and "windowspecdefinition(" in line:
            assert "_bucket" in line or "feature" in line


def test_scoring_needs_no_shuffle(spark, sf_dir):
    for name in ("risk_scores", "ranked_factors", "route_options", "weighted_contrib", "score_out_of_100"):
        assert "Exchange" not in plan(queries()[name](spark, sf_dir)), name


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(queries()["alerts_last_24_hours"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    lines = plan(sq.trade_signals(wh.shipments(wh.table(spark, sf_dir, "orders"), wh.table(spark, sf_dir, "lineitem"))))
    assert "l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in lines


def test_assembly_shares_one_partitioning(spark, sf_dir):
    """All feature tables meet the requests on request_id: no exchange above the first join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = spark.range(1000).withColumnRenamed("id", "request_id")
        tables = [spark.range(1000).selectExpr("id as request_id", f"id * 1.0D as {f}") for f in sq.NAMES[:3]]
        text = plan(sq.assemble_raw(requests, tables))
        assert text.count("Exchange (") <= 2 * 4
        joins = text.count("SortMergeJoin LeftOuter (")
        assert joins >= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_links_are_limited_in_the_map_tasks(spark, sf_dir):
    assert "WindowGroupLimit" in plan(queries()["top_links_per_request"](spark, sf_dir))


def test_ordered_rows_are_shuffled_once_and_never_written(spark, monkeypatch):
    """The running normaliser: one exchange of the rows, no checkpoint, buckets by the number of rows."""
    from laneward.operators import ordered
    from laneward.operators.normalize import normalize_running

    raw = spark.range(40_000).selectExpr("id AS request_id", "timestamp_micros(id * 1000003 % 99991) AS created_at", "id % 7.0 AS x")
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 3_000)
    placed, n = ordered.ordered_buckets(raw, ["created_at", "request_id"])
    assert n == 14
    sizes = {r[ordered.BUCKET]: r["count"] for r in placed.groupBy(ordered.BUCKET).count().collect()}
    assert sorted(sizes) == list(range(14)) and max(sizes.values()) < 2 * 40_000 / 14
    ends = placed.groupBy(ordered.BUCKET).agg({"created_at": "min"}).orderBy(ordered.BUCKET).collect()
    assert [r[1] for r in ends] == sorted(r[1] for r in ends)
    text = plan(normalize_running(raw, ["x"]))
    assert "ExistingRDD" not in text and text.count("repartition_by_id") + text.count("REPARTITION_BY_ID") + text.count("shufflepartitionid") <= 2
    assert text.count("SortMergeJoin") == 0


def test_the_whole_analysis_derives_each_request_once(spark):
    from pyspark.sql import functions as F

    from laneward.plans.from_requests import analyze_requests

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def derived(text):
        seen.add(1)
        return text

    rows = [(n, f"2024-01-01 00:{n % 60:02d}:00", f"part {n % 2}", "Taiwan", "Busan", None) for n in range(40)]
    requests = spark.createDataFrame(rows, "request_id long, at string, component string, seller_location string, import_location string, seller_name string")
    requests = requests.select("*", F.to_timestamp("at").alias("created_at"), derived.asNondeterministic()("component").alias("component_type"))
    texts = [(n, '{"edges":null}' if n % 4 == 0 else '{"inventory_days":%d}' % n, '{"news_vol_7d":%d}' % n, "{}", '{"global_risk":0.5}') for n in range(38)]
    answers = spark.createDataFrame(texts, "request_id long, trade string, news string, political string, pressure string")
    weather = spark.createDataFrame([(25.033, 121.5654, "{}")], "lat double, lon double, payload string")
    scored, rejected = analyze_requests(requests.drop("at", "component"), answers, weather, "2024-01")
    kept = {r.request_id for r in scored.collect()}
    assert kept == {n for n in range(40) if n % 4 or n >= 38}
    assert {r.request_id for r in rejected.collect()} == set(range(40)) - kept
    assert seen.value == 40  # before, for places, reuse, its buckets and the answers anew
