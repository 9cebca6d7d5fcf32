"""Gazetteer, city and geocoder-answer rules."""

import random

import pytest
from pyspark.sql import functions as F

from laneward import dims as d
from laneward.dims import dims
from laneward.operators import locate
from laneward.operators.locate import city_match, geocode_lookup, geocode_resolve, resolve_pair
from laneward.sources.payloads import geocode_payload

GAZETTEER_GOLDENS = {
    "Hsinchu, Taiwan": "hsinchu",
    "Los Angeles, USA": "los angeles",
    "New York, USA": "new york",
    "New Delhi": "delhi",
    "USA": "busan",
    " usa ": "busan",
    "US": "houston",
    "LA": "lagos",
    "Lausanne": "usa",
    "Fukuoka": "uk",
    "Ukraine": "uk",
    "UK": "uk",
    "Indiana": "india",
    "India": "india",
    "Mexico": "mexico city",
    "Sao Paulo": "sao paulo",
    "": "hsinchu",
    "São Paulo": None,
    "Taipei": None,
    "Korea": None,
    "Texas": None,
    "Antwerp": None,
}
CITY_GOLDENS = {
    "Los Angeles, USA": "LA",
    "USA": "Busan",
    " usa ": "NYC",
    "United States": "NYC",
    "Texas, USA": "NYC",
    "Lausanne": "NYC",
    "UK": "London",
    "Ukraine": "London",
    "India": "Mumbai",
    "Indiana": "Mumbai",
    "China": "Shanghai",
    "Germany": "Berlin",
    "Mexico": "Mexico",
    "South Africa": "Durban",
    "São Paulo": "SaoPaulo",
    "LA": "Lagos",
    "sao paulo": "",
    "Taiwan": "",
    "Hsinchu, Taiwan": "",
    "": "",
    None: "",
}


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "loc string")


def test_dimension_sizes(spark):
    sizes = {name: df.count() for name, df in dims(spark).items()}
    assert sizes == {"features": 7, "gazetteer": 46, "cities": 25, "country_city": 26, "graph_edges": 47}


def test_gazetteer_goldens(spark):
    got = geocode_lookup(texts(spark, GAZETTEER_GOLDENS), "loc").collect()
    assert {r["loc"]: r.place_key for r in got} == GAZETTEER_GOLDENS


def test_gazetteer_lookup_is_one_projection(spark):
    plan = geocode_lookup(texts(spark, ["USA"]), "loc")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_long_gazetteer_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(locate, "small_rows", lambda df, limit=0: d.small_rows(df, limit) if limit else None)
    got = geocode_lookup(texts(spark, GAZETTEER_GOLDENS), "loc", dims(spark)["gazetteer"]).collect()
    assert {r["loc"]: r.place_key for r in got} == GAZETTEER_GOLDENS


def test_long_gazetteer_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abc ") for _ in range(k)).strip() or "a"
    keys = [(n, word(rnd.randrange(1, 6)), float(n), 1.0) for n in range(60)]
    addresses = sorted({word(rnd.randrange(1, 9)) for _ in range(300)})
    gazetteer = spark.createDataFrame(keys, d.GAZETTEER_SCHEMA)
    monkeypatch.setattr(locate, "small_rows", lambda df, limit=0: d.small_rows(df, limit) if limit else None)
    got = {r["loc"]: r.place_key for r in geocode_lookup(texts(spark, addresses), "loc", gazetteer).collect()}
    want = {a: next((k for _, k, _, _ in keys if k in a or a in k), None) for a in addresses}
    assert got == want


def test_city_goldens(spark):
    got = city_match(texts(spark, CITY_GOLDENS), "loc").collect()
    assert {r["loc"]: r.city_id for r in got} == CITY_GOLDENS
    tables = dims(spark)
    again = city_match(texts(spark, CITY_GOLDENS), "loc", "city_id", tables["cities"], tables["country_city"])
    assert {r["loc"]: r.city_id for r in again.collect()} == CITY_GOLDENS


def test_provider_order(spark):
    p1 = spark.createDataFrame([("A", 1.0, 1.0)], "address string, lat double, lon double")
    p2 = spark.createDataFrame([("A", 2.0, 2.0), ("B", 3.0, 3.0)], "address string, lat double, lon double")
    got = geocode_resolve(texts(spark, ["A", "B", "Tokyo", "zzz"]), "loc", p1, p2).collect()
    assert {r["loc"]: r.lat for r in got} == {"A": 1.0, "B": 3.0, "Tokyo": 35.6762, "zzz": None}


@pytest.mark.parametrize("with_provider", [False, True])
def test_pair(spark, with_provider):
    df = spark.createDataFrame([("1", "Hsinchu, Taiwan", "nowhere")], "request_id string, seller_location string, import_location string")
    p1 = spark.createDataFrame([("nowhere", 9.0, 8.0)], "address string, lat double, lon double")
    row = resolve_pair(df, p1 if with_provider else None).first()
    assert (row.seller_lat, row.seller_lon) == (24.8138, 120.9675)
    assert (row.import_lat, row.import_lon) == ((9.0, 8.0) if with_provider else (None, None))


def test_geocoder_answers(spark):
    cases = {
        '[{"latitude":1.5,"longitude":2.5}]': (1.5, 2.5),
        '{"copResults":{"lat":1.5,"lng":2.5}}': (1.5, 2.5),
        '{"results":[{"lat":1.5,"lng":2.5}]}': (1.5, 2.5),
        '{"lat":1.5,"lng":2.5}': (1.5, 2.5),
        '{"lat":"1.5","lng":2.5}': (1.5, 2.5),
        '{"latitude":0,"lat":1.5,"lng":2.5}': (1.5, 2.5),
        '{"copResults":[],"results":{"lat":1.5,"lng":2.5}}': (1.5, 2.5),
        '{"copResults":[],"results":[],"lat":1.5,"lng":2.5}': (1.5, 2.5),
        '{"lat":0,"lng":2.5}': (None, None),
        '{"latitude":"x","lat":1.5,"lng":2.5}': (None, None),
        "[]": (None, None),
        '"text"': (None, None),
        "broken": (None, None),
    }
    df = spark.createDataFrame(list(cases.items()) and [(k, k) for k in cases], "address string, payload string")
    got = {r.address: (r.lat, r.lon) for r in geocode_payload(df).collect()}
    assert got == cases


def test_short_gazetteer_against_brute_force(spark):
    rnd = random.Random(6)
    word = lambda k: "".join(rnd.choice("ab.c (") for _ in range(k)).strip()
    keys = [(n, word(rnd.randrange(1, 6)) or "b", float(n), 1.0) for n in range(40)]
    addresses = sorted({word(rnd.randrange(0, 9)) for _ in range(400)})
    for rows in (keys, [*keys[:20], (20, "", 0.0, 0.0), *keys[21:]]):
        got = geocode_lookup(texts(spark, addresses), "loc", spark.createDataFrame(rows, d.GAZETTEER_SCHEMA)).collect()
        want = {a: next((k for _, k, _, _ in rows if k in a or a in k), None) for a in addresses}
        assert {r["loc"]: r.place_key for r in got} == want


def test_long_city_list_and_its_pieces_are_never_broadcast(spark):
    """A list of 100,001 keys is past what is counted as short, and Spark takes it for a few MB."""
    keys = spark.range(100_001).select(
        F.col("id").cast("int").alias("priority"), F.format_string("town%06d", "id").alias("key"), F.col("id").alias("place")
    )
    texts = spark.createDataFrame([("port of town000007 and town000003",), ("wn000",), ("town100000",), ("nowhere",), (None,)], "_text string")
    found = locate._first_by_substring(texts, keys, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the four texts may be sent to the pieces, the list and its pieces may not
    assert plan.count("BroadcastHashJoin") <= 1 and plan.count("SortMergeJoin") == 2, plan
    assert {r._text: r._hit.place for r in found.collect()} == {"port of town000007 and town000003": 3, "wn000": 0, "town100000": 100_000}
