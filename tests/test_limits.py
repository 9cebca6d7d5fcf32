"""Tables past the sizes that become literals, and rows that used to fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from laneward.operators import assemble, locate, routes, stats
from laneward.operators.features import news_features
from laneward.operators.reuse import reuse_features
from laneward.functions.text import visible_text

T = dt.datetime(2024, 1, 1)


def at(**delta):
    return T + dt.timedelta(**delta)


def test_a_mention_seen_again_counts_in_each_window(spark):
    schema = "lane int, mention_id string, ts timestamp, negative boolean, strike boolean"
    seen = [
        (1, "a", at(days=4), False, True), (1, "a", at(days=18), True, False), (1, "a", at(days=18), True, False),
        (1, "b", at(days=16), False, False), (1, "b", at(days=17), False, False), (1, "c", None, True, True),
    ]
    asked = spark.createDataFrame([(1, 1, at(days=19)), (2, 1, at(days=5)), (3, 1, at(days=11)), (4, 2, at(days=5))], "request_id int, lane int, created_at timestamp")
    for grain in (None, "day"):
        got = news_features(asked, spark.createDataFrame(seen, schema), grain, buckets=3)
        assert {r.request_id: tuple(r)[1:] for r in got.collect()} == {1: (2, 0.5, 0), 2: (1, 0.0, 1), 3: (0, 0.0, 0), 4: (0, 0.0, 0)}


def test_long_and_short_tables_agree(spark, monkeypatch):
    cities = spark.createDataFrame([(1, "b", "Porto"), (2, "p", "Port"), (3, "n", None)], "priority int, id string, name string")
    lands = spark.createDataFrame([(1, "spain", "s"), (2, None, "x")], "priority int, key string, city_id string")
    texts = [("Old Porto, Spain",), ("port",), ("SPAIN",), ("or",), ("",), (None,), ("elsewhere",)]
    df = spark.createDataFrame(texts, "loc string")
    paths = spark.createDataFrame([(["b", "z", "p"],), ([],), (["b", "b"],)], "path array<string>")
    gazetteer = spark.createDataFrame([(1, "port", 1.0, 2.0), (2, None, 3.0, 4.0), (3, "spain", 5.0, 6.0)], "priority int, key string, lat double, lon double")
    periods = spark.createDataFrame([(T, None), (at(days=2), 0.5), (None, 0.7)], "start timestamp, global_risk double")
    asked = spark.createDataFrame([(1, at(days=1)), (2, at(days=3))], "request_id int, created_at timestamp")

    def all_results():
        return [
            sorted(map(str, locate.city_match(df, "loc", cities=cities, country_city=lands).collect())),
            sorted(map(str, routes.route_text(paths, cities).collect())),
            sorted(map(str, locate.geocode_lookup(df, "loc", gazetteer).collect())),
            sorted(map(str, assemble.attach_pressure(asked, periods).select("request_id", "global_risk").collect())),
        ]

    short = all_results()
    for module in (locate, routes, assemble):
        monkeypatch.setattr(module, "small_rows", lambda *a: None)
    assert all_results() == short


def test_pressure_of_repeated_and_null_ids(spark, monkeypatch):
    rows = [(1, at(days=3), 9.0), (1, at(days=3), 9.0), (1, at(days=1), 9.0), (None, at(days=5), 9.0), (None, None, 9.0), (2, at(days=-1), 9.0)]
    asked = spark.createDataFrame(rows, "request_id int, created_at timestamp, global_risk double")
    periods = spark.createDataFrame([(T, 0.25), (at(days=2), 0.5), (at(days=4), None)], "start timestamp, global_risk double")
    want = [(1, 0.25), (1, 0.5), (1, 0.5), (2, None), (None, 0.5), (None, None)]
    for limit in (4096, 3, 2, 0):
        monkeypatch.setattr(assemble, "PERIOD_LIMIT", limit)
        got = assemble.attach_pressure(asked, periods)
        assert got.columns == asked.columns
        assert sorted(map(str, ((r.request_id, r.global_risk) for r in got.collect()))) == sorted(map(str, want))


def test_a_calendar_without_values(spark):
    periods = spark.createDataFrame([(T, None)], "start timestamp, global_risk double")
    asked = spark.createDataFrame([(1, at(days=1))], "request_id int, created_at timestamp")
    assert assemble.attach_pressure(asked, periods).first().global_risk is None


def test_negative_hardship_is_refused(spark):
    edges = spark.createDataFrame([("a", "b", -1)], "src string, dst string, hardship int")
    with pytest.raises(ValueError):
        routes.route_distance(edges, spark.createDataFrame([("a", "b")], "start string, end string"))


def test_no_row_reuses_a_later_one(spark):
    rows = spark.createDataFrame([("l", at(hours=10), "r1"), ("l", at(hours=12, minutes=5), "r2"), ("m", at(hours=10), "r3")], "lane string, created_at timestamp, request_id string")
    stored = spark.createDataFrame([("l", at(hours=12), "s")], "lane string, source_at timestamp, source_request_id string")
    got = {r.request_id: (r.source_request_id, r.is_reuse) for r in reuse_features(rows, anchors=stored, buckets=2).collect()}
    assert got == {"r1": ("r1", False), "r2": ("s", True), "r3": ("r3", False)}


def test_references_are_decoded_once(spark):
    cases = {"&#38;lt;b&#38;gt;": "&lt;b&gt;", "&eacute;&Auml;&hearts;": "éÄ♥", "<template>x</template>y": "y", "a & b &c; &amp;amp;": "a & b &c; &amp;"}
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.t for r in df.select("html", visible_text(F.col("html")).alias("t")).collect()} == cases


def test_merged_statistics(spark):
    values = [1e6 + x for x in range(40)]
    parts = [spark.createDataFrame([(v,) for v in values[i::4]], "x double") for i in range(4)]
    (r,) = stats.merge_stats(*[stats.feature_stats(p, ["x"]) for p in parts]).collect()
    assert r["count"] == 40 and abs(r["mean"] - 1e6 - 19.5) < 1e-6 and abs(r["M2"] - sum((x - 19.5) ** 2 for x in range(40))) < 1e-3
