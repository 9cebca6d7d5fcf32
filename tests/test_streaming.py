"""Streams against the batch operators, over several micro-batches and replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from laneward.operators.features import news_features
from laneward.operators.normalize import normalize_running
from laneward.operators.reuse import reuse_features
from laneward.streaming.mentions import news_features_stream
from laneward.streaming.stateful import normalize_step, normalize_stream, reuse_step, reuse_stream

START = datetime(2024, 1, 1)


def files_in_order(df, time_col, path, parts):
    """Write consecutive time slices as separate files, oldest first."""
    import os

    rows = df.orderBy(time_col, *[c for c in df.columns if c != time_col]).collect()
    size = -(-len(rows) // parts)
    os.makedirs(path)
    for k in range(parts):
        piece = df.sparkSession.createDataFrame(rows[k * size : (k + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    return path


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, offsets):
    q = writer.option("checkpointLocation", offsets).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def mentions(spark):
    rnd = random.Random(3)
    rows = [
        ("hot" if i % 3 else f"l{i % 5}", i, START + timedelta(seconds=rnd.randrange(20 * 86400)), rnd.random() < 0.3, rnd.random() < 0.05)
        for i in range(800)
    ]
    rows += [("hot", 9001, START + timedelta(days=9), True, True), rows[5]]  # on a window edge; a duplicate
    return spark.createDataFrame(rows, "lane string, mention_id long, ts timestamp, negative boolean, strike boolean")


def test_news_windows_equal_the_batch_form(spark, tmp_path):
    df = mentions(spark).cache()
    files_in_order(df, "ts", str(tmp_path / "in"), 4)
    out = news_features_stream(stream(spark, df, str(tmp_path / "in")))
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).cache()
    assert got.count() > 50
    assert got.groupBy("lane", "as_of").count().where("count > 1").isEmpty()
    requests = got.select(F.concat_ws("@", "lane", "as_of").alias("request_id"), "lane", F.col("as_of").alias("created_at"))
    want = {r.request_id: r for r in news_features(requests, df).collect()}
    for r in got.withColumn("request_id", F.concat_ws("@", "lane", "as_of")).collect():
        w = want[r.request_id]
        assert (r.news_vol_7d, r.strike_flag_7d) == (w.news_vol_7d, w.strike_flag_7d)
        assert r.neg_tone_frac_3d == pytest.approx(w.neg_tone_frac_3d)
    last = df.agg(F.max("ts")).first()[0] - timedelta(days=1)
    assert got.agg(F.max("as_of")).first()[0] == datetime(last.year, last.month, last.day)


def test_news_windows_drop_late_rows(spark, tmp_path):
    schema = "lane string, mention_id long, ts timestamp, negative boolean, strike boolean"
    early = [("a", n, START + timedelta(days=n), False, False) for n in range(15)]
    later = [("a", 99, START + timedelta(days=15), False, False)]
    late = [("a", 100, START + timedelta(hours=1), True, True), ("a", 101, START + timedelta(days=16), False, False)]
    import os

    path = str(tmp_path / "in")
    for k, rows in enumerate((early, later, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    df = spark.createDataFrame(early, schema)
    run(news_features_stream(stream(spark, df, path)).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("strike_flag_7d")).first()[0] == 0


def feature_rows(spark, n=600):
    rnd = random.Random(8)
    rows = [(f"q{i:04d}", START + timedelta(minutes=rnd.randrange(5000)), rnd.gauss(50, 9), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, created_at timestamp, x double, y double")


def as_dict(df, *cols):
    return {r.request_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_normaliser_stream_and_restart(spark, tmp_path):
    df = feature_rows(spark).cache()
    path = files_in_order(df, "created_at", str(tmp_path / "in"), 4)
    state, out, offsets = (str(tmp_path / n) for n in ("state", "out", "ck"))

    def start():
        return run(normalize_stream(stream(spark, df, path), ["x", "y"], state, out), offsets)

    start()
    start()  # nothing new: nothing counted again
    want = as_dict(normalize_running(df, ["x", "y"]), "x", "y")
    got = as_dict(spark.read.parquet(out), "x", "y")
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_normaliser_replay_of_a_batch(spark, tmp_path):
    df = feature_rows(spark, 300).orderBy("created_at", "request_id").cache()
    rows = df.collect()
    parts = [spark.createDataFrame(rows[k : k + 100], df.schema) for k in (0, 100, 200)]
    step = normalize_step(["x", "y"], str(tmp_path / "state"), str(tmp_path / "out"))
    for batch_id, part in enumerate(parts):
        step(part, batch_id)
        step(part, batch_id)  # a replay after a failure
    want = as_dict(normalize_running(df, ["x", "y"]), "x")
    got = as_dict(spark.read.parquet(str(tmp_path / "out")), "x")
    assert len(got) == 300
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def request_rows(spark, n=500):
    rnd = random.Random(12)
    rows = [("hot" if i % 3 else f"l{i % 6}", START + timedelta(seconds=rnd.randrange(60_000)), f"q{i:04d}") for i in range(n)]
    return spark.createDataFrame(rows, "lane string, created_at timestamp, request_id string")


def test_reuse_stream(spark, tmp_path):
    df = request_rows(spark).cache()
    path = files_in_order(df, "created_at", str(tmp_path / "in"), 3)
    run(reuse_stream(stream(spark, df, path), str(tmp_path / "state"), str(tmp_path / "out")), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert as_dict(got, "source_request_id", "is_reuse") == as_dict(reuse_features(df), "source_request_id", "is_reuse")


def test_reuse_replay_of_a_batch(spark, tmp_path):
    df = request_rows(spark, 200).orderBy("created_at", "request_id").cache()
    rows = df.collect()
    step = reuse_step(str(tmp_path / "state"), str(tmp_path / "out"))
    for batch_id, k in enumerate((0, 100)):
        part = spark.createDataFrame(rows[k : k + 100], df.schema)
        step(part, batch_id)
        step(part, batch_id)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert as_dict(got, "source_request_id") == as_dict(reuse_features(df), "source_request_id")


def shuffled_batches(rows, time, parts, minutes):
    """Batches in order of a time that is wrong by up to ``minutes``: rows come out of order, within the lateness."""
    rnd = random.Random(5)
    rows = sorted(rows, key=lambda r: r[time] + timedelta(minutes=rnd.random() * minutes))
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def in_steps(spark, tmp_path, batches, schema, build):
    """The stream's rows, stopped and started again after each batch."""
    import os

    path = str(tmp_path / "in")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
        rows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        run(build(rows_in).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ck"))
    spark.conf.set("spark.sql.shuffle.partitions", width)
    return spark.read.parquet(str(tmp_path / "out"))


def test_reuse_by_keyed_state_out_of_order_with_restarts(spark, tmp_path):
    from laneward.streaming.keyed import reuse_lane_stream

    rnd = random.Random(21)
    rows = [
        (None if i % 11 == 0 else "hot" if i % 3 else f"l{i % 6}", START + timedelta(seconds=rnd.randrange(60_000)), f"q{i:04d}")
        for i in range(400)
    ]
    rows += [(None, START + timedelta(hours=8), "twice"), (None, START + timedelta(hours=8), "twice")]  # repeated
    batches = shuffled_batches(rows, 1, 3, 14)
    end = START + timedelta(hours=40)
    batches.append([("hot", START + timedelta(minutes=3), "late"), ("end", end, "end"), ("hot", None, "no time")])
    batches.append([("end", end + timedelta(hours=1), "end2"), ("hot", START + timedelta(hours=1), "late2")])
    schema = "lane string, created_at timestamp, request_id string"
    got = in_steps(spark, tmp_path, batches, schema, reuse_lane_stream)
    late = {r.request_id for r in got.where("is_late").collect()}
    assert late >= {"late2"} and "no time" not in {r.request_id for r in got.collect()}
    timely = spark.createDataFrame([r for b in batches for r in b if r[1] and r[2] not in late], schema)
    want = reuse_features(timely).where(~F.col("request_id").isin("end", "end2"))

    def listed(df):
        return sorted(map(repr, df.select("lane", "created_at", "request_id", "source_request_id", "source_at", "is_reuse").collect()))

    assert listed(got.where("NOT is_late AND lane <=> 'end' = false")) == listed(want)
    assert late <= {"late", "late2"}


def test_lane_normaliser_by_keyed_state(spark, tmp_path):
    from laneward.streaming.keyed import normalize_lane_stream

    rnd = random.Random(4)
    rows = [
        ("hot" if i % 3 else f"l{i % 5}", START + timedelta(minutes=rnd.randrange(20 * 1440)), i, None if i % 13 == 0 else 1e6 + rnd.gauss(50, 9), rnd.random())
        for i in range(500)
    ]
    batches = shuffled_batches(rows, 1, 3, 600)
    batches.append([("end", START + timedelta(days=60), 1000, 1.0, 1.0)])
    schema = "lane string, created_at timestamp, request_id int, x double, y double"
    got = in_steps(spark, tmp_path, batches, schema, lambda df: normalize_lane_stream(df, ["x", "y"]))
    assert got.where("is_late").isEmpty()
    want = as_dict(normalize_running(spark.createDataFrame(rows, schema), ["x", "y"], scope=["lane"]), "x", "y")
    found = as_dict(got, "x", "y")
    assert found.keys() == want.keys()
    for k in want:
        assert found[k] == pytest.approx(want[k], abs=1e-6)
