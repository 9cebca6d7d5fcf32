"""Anchored reuse and as-of lookup, on hot lanes and across buckets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from laneward.operators.features import asof_features, news_features, stock_days
from laneward.operators.reuse import last_anchors, reuse_features

START = datetime(2024, 1, 1)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lane string, t double, request_id string")
    return df.select("lane", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("created_at"), "request_id")


def chain(rows, ttl=900, anchors=None):
    """Brute force over (lane, t, id)."""
    last = dict(anchors or {})
    out = {}
    for lane, t, rid in sorted(rows):
        if lane not in last or t - last[lane][0] >= ttl:
            last[lane] = (t, rid)
        out[rid] = last[lane][1]
    return out


def test_golden(spark):
    seconds = [0, 600, 899, 900, 1740, 1860]
    got = reuse_features(frame(spark, [("a", float(s), f"r{s:04d}") for s in seconds])).collect()
    assert {r.request_id: r.source_request_id for r in got} == {
        "r0000": "r0000", "r0600": "r0000", "r0899": "r0000", "r0900": "r0900", "r1740": "r0900", "r1860": "r1860"}
    assert {r.request_id for r in got if not r.is_reuse} == {"r0000", "r0900", "r1860"}


def traffic(kind, n=2000, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lane = "hot" if i % 3 else f"l{rnd.randrange(15)}"
        t = {"dense": rnd.randrange(40_000_000) / 1000, "even": float(i * 7), "sparse": rnd.random() * 5e6,
             "ties": float(rnd.randrange(30) * 300)}[kind]
        rows.append((lane, t, f"q{i:05d}"))
    return rows


@pytest.mark.parametrize("kind", ["dense", "even", "sparse", "ties"])
def test_against_brute_force_over_many_buckets(spark, kind):
    rows = traffic(kind)
    got = reuse_features(frame(spark, rows), buckets=20)
    found = {r.request_id: r.source_request_id for r in got.collect()}
    assert found == chain(rows)
    gaps = got.where("not is_reuse").selectExpr(
        "unix_micros(created_at) - lag(unix_micros(created_at)) over (partition by lane order by created_at) as gap")
    assert gaps.agg(F.min("gap")).first()[0] >= 900_000_000


def test_continues_from_stored_anchors(spark):
    rows = traffic("dense")
    early = [r for r in rows if r[1] < 20_000]
    late = [r for r in rows if r[1] >= 20_000]
    first = reuse_features(frame(spark, early), buckets=5).cache()
    second = reuse_features(frame(spark, late), anchors=last_anchors(first), buckets=5)
    found = {r.request_id: r.source_request_id for r in first.unionByName(second).collect()}
    assert found == chain(rows)


@pytest.mark.parametrize("buckets", [1, 2, 12])
def test_rows_without_a_lane_are_a_lane_of_their_own(spark, buckets):
    rows = [(None if i % 4 == 0 else lane, t, rid) for i, (lane, t, rid) in enumerate(traffic("dense", 900))]
    named = chain([(lane or "", t, rid) for lane, t, rid in rows])
    got = reuse_features(frame(spark, rows), buckets=buckets)
    assert {r.request_id: r.source_request_id for r in got.collect()} == named
    first = reuse_features(frame(spark, [r for r in rows if r[1] < 20_000]), buckets=buckets).cache()
    later = frame(spark, [r for r in rows if r[1] >= 20_000])
    second = reuse_features(later, anchors=last_anchors(first), buckets=buckets)
    assert {r.request_id: r.source_request_id for r in first.unionByName(second).collect()} == named


def test_asof_lookup(spark):
    rnd = random.Random(4)
    requests = [("hot" if i % 3 else f"l{i % 7}", rnd.randrange(200_000) / 10, f"q{i}") for i in range(900)]
    feats = [("hot" if i % 2 else f"l{i % 7}", rnd.randrange(200_000) / 10, float(i)) for i in range(200)]
    feat_frame = spark.createDataFrame(feats, "lane string, t double, x double").select(
        "lane", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("computed_at"), "x")
    got = {r.request_id: r.x for r in asof_features(frame(spark, requests), feat_frame, 900, buckets=16).collect()}
    assert len(got) == 900
    for lane, t, rid in requests:
        older = [(ft, x) for fl, ft, x in feats if fl == lane and ft <= t]
        newest = max((ft for ft, _ in older), default=None)
        if newest is None or t - newest >= 900:
            assert got[rid] is None
        else:
            assert got[rid] in {x for ft, x in older if ft == newest}


@pytest.mark.parametrize("grain", [None, "day"])
def test_trailing_news_features(spark, grain):
    rnd = random.Random(9)
    mentions = []
    for i in range(1500):
        at = START + timedelta(seconds=rnd.randrange(30 * 86400))
        if i % 50 == 0:
            at = at.replace(hour=0, minute=0, second=0)
        mentions.append(("hot" if i % 3 else f"l{i % 5}", i, at, rnd.random() < 0.3, rnd.random() < 0.02))
    mentions.append(mentions[0])
    requests = []
    for i in range(300):
        at = START + timedelta(days=rnd.randrange(35), seconds=0 if grain else rnd.randrange(86400))
        requests.append((f"q{i}", "hot" if i % 3 else f"l{i % 6}", at))
    rf = spark.createDataFrame(requests, "request_id string, lane string, created_at timestamp")
    mf = spark.createDataFrame(mentions, "lane string, mention_id long, ts timestamp, negative boolean, strike boolean")
    got = {r.request_id: r for r in news_features(rf, mf, grain, buckets=16).collect()}
    distinct = {m[1]: m for m in mentions}.values()
    for rid, lane, at in requests:
        week = [m for m in distinct if m[0] == lane and at - timedelta(days=7) < m[2] <= at]
        late = [m for m in week if m[2] > at - timedelta(days=3)]
        row = got[rid]
        assert row.news_vol_7d == len(week)
        assert row.neg_tone_frac_3d == pytest.approx(sum(m[3] for m in late) / len(late) if late else 0.0)
        assert row.strike_flag_7d == int(any(m[4] for m in week))


def test_stock_days_with_gaps_and_first_periods(spark):
    rnd = random.Random(6)
    moves = []
    for lane, n in (("hot", 900), ("few", 12), (None, 40)):
        for _ in range(n):
            day = START + timedelta(days=rnd.choice([rnd.randrange(40), 100 + rnd.randrange(30), 300]))
            moves.append((lane, day.date(), rnd.choice([None, 0.0, 5.0, 9.0]), rnd.choice([None, 0.0, 1.0, 6.0])))
    moves.append(("still", START.date(), 4.0, None))
    df = spark.createDataFrame(moves, "lane string, day date, inflow double, outflow double")
    got = {(r.lane, r.day): (r.stock, r.daily_outflow, r.stock_days) for r in stock_days(df, 30, buckets=9).collect()}
    assert set(got) == {m[:2] for m in moves}
    for (lane, day), (stock, rate, lasts) in got.items():
        mine = [m for m in moves if m[0] == lane and m[1] <= day]
        span = min(30, (day - min(m[1] for m in mine)).days + 1)
        recent = sum(m[3] or 0 for m in mine if (day - m[1]).days < 30) / span
        assert stock == sum((m[2] or 0) - (m[3] or 0) for m in mine) and rate == pytest.approx(recent)
        assert lasts is None if recent == 0 else lasts == pytest.approx(max(stock, 0) / recent)
    assert got["still", START.date()] == (4.0, 0.0, None)
