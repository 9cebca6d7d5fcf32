"""Normaliser, score, labels, ranking: golden rows and properties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from laneward.dims import FEATURES
from laneward.functions.risk import factor_percent, risk_label, squash
from laneward.operators.assemble import assemble_raw, attach_pressure, pressure_periods, to_long
from laneward.operators.model import score_with
from laneward.operators.normalize import normalize_running
from laneward.operators.scoring import (
    FeatureSpec,
    factor_names,
    factor_rows,
    feature_specs,
    rank_factors,
    risk_score,
    risk_score_from_long,
    route_options,
    score_points,
    weighted_contrib,
    with_factors,
    with_identity,
)
from laneward.operators.stats import feature_stats, merge_stats
from laneward.plans.analyze import analyze, reports

NAMES = [f[0] for f in FEATURES]
RAW = [
    ("r1", "2024-01-01", 45.0, 8.0, 12.0, 0.35, 0.0, 1.0, 0.18),
    ("r2", "2024-01-02", 30.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.20),
    ("r3", "2024-01-03", 60.0, 20.0, 30.0, 0.8, 1.0, 1.0, 0.90),
]
NORMALISED = {
    "r1": [0.5] * 7,
    "r2": [0.330238, 0.330238, 0.330238, 0.330238, 0.5, 0.330238, 0.669762],
    "r3": [0.731059, 0.756557, 0.742619, 0.738650, 0.760368, 0.640457, 0.760306],
}
SCORES = {"r1": (0.5, "Medium"), "r2": (0.372679, "Medium"), "r3": (0.735830, "High")}
RANKING = {
    "r1": [("inventory_days", 10.0), ("past_delay_days", 10.0), ("news_vol_7d", 7.5), ("neg_tone_frac_3d", 7.5),
           ("strike_flag_7d", 7.5), ("weather_anomaly_7d", 5.0), ("global_risk", 2.5)],
    "r2": [("strike_flag_7d", 7.5), ("inventory_days", 6.6), ("past_delay_days", 6.6), ("news_vol_7d", 4.95),
           ("neg_tone_frac_3d", 4.95), ("global_risk", 3.35), ("weather_anomaly_7d", 3.3)],
    "r3": [("past_delay_days", 15.13), ("inventory_days", 14.62), ("strike_flag_7d", 11.41), ("news_vol_7d", 11.14),
           ("neg_tone_frac_3d", 11.08), ("weather_anomaly_7d", 6.4), ("global_risk", 3.8)],
}


def raw_frame(spark, rows=RAW):
    schema = "request_id string, day string, " + ", ".join(f"{n} double" for n in NAMES)
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("created_at", F.to_timestamp("day")).drop("day")


@pytest.fixture(scope="module")
def scored(spark):
    requests = raw_frame(spark)
    df = analyze(requests.select("request_id", "created_at"), [requests.drop("created_at")])
    return df.cache()


def test_weights_sum_to_one():
    assert sum(f[1] for f in FEATURES) == 1.0


def test_golden_rows(scored):
    for row in scored.collect():
        got = [row[n] for n in NAMES]
        assert got == pytest.approx(NORMALISED[row.request_id], abs=5e-7)
        score, label = SCORES[row.request_id]
        assert row.risk_score == pytest.approx(score, abs=5e-7)
        assert row.risk_label == label
        assert [(f.name, f.percent) for f in row.factors] == RANKING[row.request_id]
        assert {f.level for f in row.factors} == {"Low"}


def test_rank_table_equals_rank_in_row(scored):
    rows = factor_rows(scored)
    ordinal = F.element_at(F.create_map(*[F.lit(x) for n, f in enumerate(NAMES) for x in (f, n)]), F.col("name"))
    again = rank_factors(rows.drop("rank").withColumn("ordinal", ordinal))
    key = lambda r: (r.request_id, r["rank"], r.name, r.percent)
    assert sorted(map(key, rows.collect())) == sorted(map(key, again.collect()))


def test_score_from_long_rows(scored):
    long = risk_score_from_long(weighted_contrib(scored))
    assert {r.request_id: r.risk_score for r in long.collect()} == pytest.approx(
        {r.request_id: r.risk_score for r in scored.collect()}
    )


def test_labels(spark):
    df = spark.createDataFrame([(0.66,), (0.6599,), (0.33,), (0.3299,)], "s double")
    assert [r[0] for r in df.select(risk_label(F.col("s"))).collect()] == ["High", "Medium", "Medium", "Low"]


def test_missing_feature_is_neutral_and_unweighted_is_ignored(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "request_id string, x double, y double")
    specs = [FeatureSpec("x", 0.5), FeatureSpec("y", 0.25), FeatureSpec("z", 1.25)]
    row = risk_score(df, specs).first()
    assert row.risk_score == pytest.approx(1.0)  # 0.5 + 0.125 + 0.625 clipped to 1
    shares = {r.feature: r["share"] for r in weighted_contrib(df, specs).collect()}
    assert shares == pytest.approx({"x": 0.25, "y": 0.0625, "z": 0.3125})


def test_single_weight_level_follows_the_value(spark):
    df = spark.createDataFrame([("a", 0.9)], "request_id string, x double")
    factor = with_factors(df, [FeatureSpec("x", 3.0)]).first().factors[0]
    assert (factor.level, factor.percent, factor.impact) == ("High", 90.0, "Contributing risk factor")


def test_weight_table(spark):
    table = spark.createDataFrame([(2, "global_risk", 0.4), (1, "port_load", 0.6)], "ordinal int, feature string, weight double")
    specs = feature_specs(table)
    assert [(s.feature, s.weight) for s in specs] == [("port_load", 0.6), ("global_risk", 0.4)]
    assert specs[1].default_value == 0.2
    assert [s.feature for s in feature_specs(table.limit(0))] == NAMES


def test_assembly_defaults_and_carried_columns(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "request_id string")
    trade = spark.createDataFrame([("a", 12.0, None)], "request_id string, inventory_days double, past_delay_days double")
    political = spark.createDataFrame([("a", 1)], "request_id string, sanction_flag int")
    rows = {r.request_id: r for r in assemble_raw(requests, [trade, political]).collect()}
    assert (rows["a"].inventory_days, rows["a"].past_delay_days, rows["a"].sanction_flag) == (12.0, 5.0, 1)
    assert [rows["b"][n] for n in NAMES] == [30.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.2]


def test_pressure_as_of_month(spark):
    months = spark.createDataFrame([("2024-01", 0.3), ("2024-03", 0.7), ("bad", 0.9)], "month string, global_risk double")
    requests = spark.createDataFrame(
        [("a", "2023-12-31"), ("b", "2024-01-01"), ("c", "2024-02-29"), ("d", "2024-05-01")], "request_id string, d string"
    ).withColumn("created_at", F.to_timestamp("d"))
    got = {r.request_id: r.global_risk for r in attach_pressure(requests, pressure_periods(months)).collect()}
    assert got == {"a": None, "b": 0.3, "c": 0.3, "d": 0.7}


def test_pressure_beyond_the_calendar_limit_gives_the_same(spark, monkeypatch):
    import laneward.operators.assemble as assemble

    months = spark.createDataFrame([("2024-01", 0.3), ("2024-03", 0.7)], "month string, global_risk double")
    requests = spark.createDataFrame(
        [("a", "2023-12-31"), ("b", "2024-01-01"), ("c", "2024-02-29"), ("d", "2024-05-01")], "request_id string, d string"
    ).withColumn("created_at", F.to_timestamp("d"))
    monkeypatch.setattr(assemble, "PERIOD_LIMIT", 1)
    got = {r.request_id: r.global_risk for r in attach_pressure(requests, pressure_periods(months)).collect()}
    assert got == {"a": None, "b": 0.3, "c": 0.3, "d": 0.7}


# --- running normaliser -----------------------------------------------------


def plain_running(df, feature, scope=()):
    """The one-window form, for comparison only."""
    w = Window.partitionBy(*(scope or [F.lit(1)])).orderBy("created_at", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    n, mean = F.count(feature).over(w), F.avg(feature).over(w)
    return df.withColumn("expected", squash(F.col(feature), n, mean, F.var_pop(feature).over(w) * n))


def random_rows(spark, n=3000, shift=0.0, hot=True):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        # a third of the rows shares one time and one lane
        at = 500 if hot and i % 3 == 0 else rnd.randrange(1000)
        lane = "hot" if hot and i % 3 == 0 else f"l{rnd.randrange(20)}"
        x = None if rnd.random() < 0.05 else shift + rnd.gauss(0, 1)
        rows.append((f"q{rnd.random():.12f}", at, lane, x, rnd.random()))
    df = spark.createDataFrame(rows, "request_id string, t long, lane string, x double, y double")
    return df.withColumn("created_at", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize("shift,tolerance", [(0.0, 1e-9), (1e9, 2e-5)])
def test_bucketed_equals_plain_window(spark, shift, tolerance):
    df = random_rows(spark, shift=shift).cache()
    got = {r.request_id: r.x for r in normalize_running(df, ["x", "y"], buckets=16).collect()}
    want = {r.request_id: r.expected for r in plain_running(df, "x").collect()}
    assert len(got) == len(want) == 3000
    for key, value in want.items():
        assert (got[key] is None) == (value is None)
        if value is not None:
            assert got[key] == pytest.approx(value, abs=tolerance)


def test_scoped_history(spark):
    df = random_rows(spark).cache()
    got = {r.request_id: r.x for r in normalize_running(df, ["x"], scope=["lane"], buckets=16).collect()}
    want = {r.request_id: r.expected for r in plain_running(df, "x", ["lane"]).collect()}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(
        {k: v for k, v in want.items() if v is not None}, abs=1e-9
    )


@pytest.mark.parametrize("scope", [[], ["lane"]])
def test_two_halves_with_state_equal_one_run(spark, scope):
    from laneward.operators.stats import stats_long

    df = random_rows(spark, 1500).cache()
    whole = {r.request_id: r.x for r in normalize_running(df, ["x", "y"], scope=scope).collect()}
    early, late = df.where("created_at < timestamp_seconds(500)"), df.where("created_at >= timestamp_seconds(500)")
    state = stats_long(early, scope, ["x", "y"])
    parts = {r.request_id: r.x for r in normalize_running(early, ["x", "y"], scope=scope).collect()}
    parts |= {r.request_id: r.x for r in normalize_running(late, ["x", "y"], scope=scope, state=state).collect()}
    assert {k: v for k, v in parts.items() if v is not None} == pytest.approx(
        {k: v for k, v in whole.items() if v is not None}, abs=1e-9
    )


def test_merge_stats_is_stable_when_shifted(spark):
    df = random_rows(spark, shift=1e9)
    parts = [df.where(F.pmod(F.xxhash64("request_id"), F.lit(4)) == k) for k in range(4)]
    merged = {r.feature: r for r in merge_stats(*[feature_stats(p, ["x", "y"]) for p in parts]).collect()}
    whole = {r.feature: r for r in feature_stats(df, ["x", "y"]).collect()}
    for f in ("x", "y"):
        assert merged[f]["count"] == whole[f]["count"]
        assert merged[f]["mean"] == pytest.approx(whole[f]["mean"], rel=1e-12)
        assert merged[f]["M2"] == pytest.approx(whole[f]["M2"], rel=1e-6)


def test_first_two_requests_ignore_magnitude(spark):
    for jump in (1.0, 1e6):
        df = raw_frame(spark, [("a", "2024-01-01", *[1.0] * 7), ("b", "2024-01-02", 1.0 + jump, *[1.0] * 6)])
        row = {r.request_id: r for r in normalize_running(df, NAMES).collect()}["b"]
        assert row.inventory_days == pytest.approx(0.669762, abs=5e-7)
        assert row.past_delay_days == 0.5


def test_scores_are_bounded_and_monotone(spark):
    rnd = random.Random(3)
    rows = [(f"{i}", *[rnd.random() for _ in NAMES]) for i in range(50)]
    df = spark.createDataFrame(rows, "request_id string, " + ", ".join(f"{n} double" for n in NAMES))
    low = {r.request_id: r.risk_score for r in risk_score(df).collect()}
    high = {r.request_id: r.risk_score for r in risk_score(df.withColumn("news_vol_7d", F.col("news_vol_7d") + 0.2)).collect()}
    share = {
        r.request_id: r.s for r in weighted_contrib(df).groupBy("request_id").agg(F.sum("share").alias("s")).collect()
    }
    for k, v in low.items():
        assert 0 <= v <= 1 and high[k] >= v and share[k] == pytest.approx(v)


def test_rounding_of_exact_ties(spark):
    assert spark.range(1).select(factor_percent(F.lit(0.00125)).alias("p")).first().p == 0.13


# --- report and display -----------------------------------------------------


def test_report_rows(scored, tmp_path):
    from laneward.sources.requests import write_reports

    write_reports(reports(scored), str(tmp_path / "out"), "json")
    back = {r.request_id: r for r in scored.sparkSession.read.json(str(tmp_path / "out")).collect()}
    row = back["r3"]
    assert row.result.risk_label == "High"
    assert row.concise[0].name == "past_delay_days"
    assert row.concise == row.comprehensive.risk_distribution
    assert sum(row.result.risk_components.asDict().values()) == pytest.approx(row.result.risk_score)
    assert len(row.comprehensive.mitigation_strategies) == 3


def test_points_and_route_options(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.31), ("c", 1.0), ("d", 0.125)], "request_id string, risk_score double")
    df = df.withColumn("risk_label", risk_label(F.col("risk_score")))
    points = {r.request_id: (r.score_100, r.reliability) for r in score_points(df).collect()}
    assert points == {"a": (50, 50), "b": (31, 69), "c": (100, 0), "d": (13, 88)}
    routes = {(r.request_id, r.route_no): (r.risk, r.reliability) for r in route_options(df).collect()}
    assert routes[("a", 2)] == ("Medium", 45)
    assert routes[("b", 3)] == ("High", 59)
    assert routes[("c", 3)] == ("High", -10)


def test_display_names(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, "political_score", "sanctions"]], "name string")
    got = {r.name: (r.display_name, r.category) for r in factor_names(df).collect()}
    assert got["news_vol_7d"] == ("News Vol 7d", "other")
    assert got["weather_anomaly_7d"] == ("Weather Anomaly 7d", "weather")
    assert got["strike_flag_7d"][1] == "strike"
    assert got["political_score"][1] == "political" and got["sanctions"][1] == "sanctions"


def test_identity_only_where_absent(spark):
    df = spark.createDataFrame([("given",), (None,)], "request_id string")
    ids = [r.request_id for r in with_identity(df).collect()]
    assert ids[0] == "given" and len(ids[1]) == 36


def test_pluggable_model(scored):
    def model(batch):
        return batch["news_vol_7d"] * 2, batch * 0.1

    rows = {r.request_id: r for r in score_with(scored, model, NAMES).collect()}
    assert rows["r3"].risk_score == 1.0
    assert rows["r2"].risk_score == pytest.approx(0.660476, abs=1e-6)
    assert rows["r1"].risk_components["global_risk"] == pytest.approx(0.05)


def test_long_form(spark):
    df = raw_frame(spark)
    assert to_long(df, NAMES).count() == 21


def test_far_values_do_not_overflow(spark):
    value, n, mean, m2 = F.lit(1e300), F.lit(10.0), F.lit(0.0), F.lit(9e-12)
    assert spark.range(1).select(squash(value, n, mean, m2).alias("v")).first().v == 1.0
    assert spark.range(1).select(squash(-value, n, mean, m2).alias("v")).first().v == 0.0
