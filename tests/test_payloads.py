"""Weather, search, page, edge and answer scans."""

import json

import pytest
from pyspark.sql import functions as F

from laneward.functions.text import lane_key, strip_fences, visible_text
from laneward.operators.features import weather_anomaly
from laneward.operators.mentions import mention_match, query_terms, requests_of_matches, search_queries
from laneward.operators.ranking import first_seen_links, link_positions, top_k
from laneward.sources.answers import NEWS_ANSWER, POLITICAL_ANSWER, feature_json, pressure_answer, trade_json
from laneward.sources.payloads import edges_valid, page_filter, page_text, search_links, weather_daily, weather_flags
from laneward.sources.requests import read_requests
from laneward.sources.state import load_state, save_state


def shape_a(temps):
    return json.dumps({"daily": [{"temp": {"day": t}} for t in temps]})


def shape_b(temps):
    return json.dumps({"forecast": {"forecastday": [{"day": {"avgtemp_c": t}} for t in temps]}})


SECOND = [20.0, 21.0, 19.0, 20.0, 35.0]
WEATHER = {
    "constant": ([20.0] * 5, 0),
    "second": (SECOND, 1),
    "four": ([20.0, 21.0, 19.0, 35.0], 0),
    "on the limit": ([10.0, 12.0, 14.0, 16.0, 18.0, 20.0, 22.0], 0),
    "two levels": ([1.0, 1.0, 1.0, 9.0, 9.0, 9.0], 0),
}


def weather_frame(spark):
    rows = []
    for name, (temps, flag) in WEATHER.items():
        rows += [(name + " a", shape_a(temps), flag), (name + " b", shape_b(temps), flag)]
    lacking = json.loads(shape_a(SECOND))
    del lacking["daily"][0]["temp"]["day"]
    skipped = json.loads(shape_a(SECOND))
    skipped["daily"].append({"humidity": 3})
    nulled = json.loads(shape_a(SECOND))
    nulled["daily"].append({"temp": None})
    text = json.loads(shape_a(SECOND))
    text["daily"].append({"temp": {"day": "20"}})
    both = json.loads(shape_a([20.0] * 5)) | json.loads(shape_b(SECOND))
    rescued = lacking | json.loads(shape_b(SECOND))
    rows += [
        ("temp lacks day", json.dumps(lacking), 0),
        ("row lacks temp", json.dumps(skipped), 1),
        ("temp is null", json.dumps(nulled), 0),
        ("temp is text", json.dumps(text), 0),
        ("second shape fires", json.dumps(both), 1),
        ("other shape broken", json.dumps(rescued), 1),
        ("empty", "{}", 0),
        ("broken", "not json", 0),
        ("no payload", None, 0),
    ]
    return spark.createDataFrame(rows, "lane string, payload string, expected int")


def test_weather_flags_per_payload(spark):
    df = weather_frame(spark)
    want = {r.lane: r.expected for r in df.collect()}
    assert {r.lane: r.weather_anomaly_7d for r in weather_flags(df).collect()} == want


def test_weather_by_daily_rows(spark):
    df = weather_frame(spark)
    want = {r.lane: r.expected for r in df.collect()}
    got = {r.lane: r.weather_anomaly_7d for r in weather_anomaly(weather_daily(df)).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert set(want) - set(got) == {"empty", "broken", "no payload"}


def test_links(spark):
    items = [{"link": f"u{n}"} for n in range(8)]
    items[1] = {"title": "none"}
    items[2] = {"link": ""}
    rows = [("r", 1, json.dumps({"organic_results": items})), ("r", 2, json.dumps({"organic_results": [{"link": "u5"}, {"link": "u9"}]})),
            ("r", 3, "{}"), ("r", 4, "oops")]
    df = spark.createDataFrame(rows, "request_id string, query_no int, payload string")
    links = search_links(df)
    assert [(r.query_no, r["rank"], r.link) for r in links.orderBy("query_no", "rank").collect()] == [
        (1, 1, "u0"), (1, 4, "u3"), (1, 5, "u4"), (1, 6, "u5"), (2, 1, "u5"), (2, 2, "u9")]
    placed = link_positions(first_seen_links(links))
    assert [r.link for r in placed.orderBy("position").collect()] == ["u0", "u3", "u4", "u5", "u9"]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = top_k(df, ["g"], ["id"], 2)
    assert sorted((r.g, r.id) for r in top.collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_pages(spark):
    df = spark.createDataFrame(
        [(1, 200, "text/html; charset=utf-8"), (2, 404, "text/html"), (3, 200, "application/pdf"), (4, 200, None)],
        "id int, status int, content_type string")
    assert [r.id for r in page_filter(df).collect()] == [1]


def test_visible_text(spark):
    cases = {
        "<p>a<b>b</b> c</p>": "a b c",
        "<title>T</title><style>p{}</style><script>if(a<b)</script>x<!-- y <p> -->z": "T x z",
        "a&amp;lt;b &quot;q&quot; &#233;&#xe9; &copy;": 'a&lt;b "q" éé ©',
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "open <script>var a = '<p>text</p>'": "open",
        "&#0; &#1114112;": "� �",
        "  \n ": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    assert {r.html: r.t for r in df.select("html", visible_text(F.col("html")).alias("t")).collect()} == cases
    long = spark.createDataFrame([("<p>" + "ab " * 4000,), (None,)], "html string")
    assert [len(r.text) for r in page_text(long).collect()] == [5000]


def test_lane_key(spark):
    df = spark.createDataFrame([("c", "s", "i", None), ("c", "s", "i", "n")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(lane_key(*[F.col(x) for x in "abcd"])).collect()] == ["c|s|i|", "c|s|i|n"]


def test_strip_fences(spark):
    cases = {"```json\n{\"a\":1}\n```": '{"a":1}', " \n x\t": "x", "": "{}", None: "{}"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", strip_fences(F.col("t")).alias("s")).collect()} == cases


NEWS = {
    '{"news_vol_7d":4,"neg_tone_frac_3d":0.25,"strike_flag_7d":1}': (4, 0.25, 1),
    '```json\n{"news_vol_7d":4,"neg_tone_frac_3d":0.25,"strike_flag_7d":1}\n```': (4, 0.25, 1),
    '{"news_vol_7d":3.7}': (3, 0.0, 0),
    '{"news_vol_7d":"3","strike_flag_7d":1}': (3, 0.0, 1),
    '{"news_vol_7d":"3.7","strike_flag_7d":1}': (0, 0.0, 0),
    '{"news_vol_7d":null,"strike_flag_7d":1}': (0, 0.0, 0),
    '{"news_vol_7d":true,"strike_flag_7d":false}': (1, 0.0, 0),
    '{"news_vol_7d":[1],"strike_flag_7d":1}': (0, 0.0, 0),
    "not JSON": (0, 0.0, 0),
    "[1]": (0, 0.0, 0),
    "": (0, 0.0, 0),
}


def test_news_answers(spark):
    df = spark.createDataFrame([(k,) for k in NEWS], "answer string")
    got = {r.answer: (r.news_vol_7d, r.neg_tone_frac_3d, r.strike_flag_7d) for r in feature_json(df, "answer", NEWS_ANSWER).collect()}
    assert got == NEWS


def test_other_answers(spark):
    cases = {
        '{"sanction_flag":1,"political_risk_score":0.7,"notes":"n"}': (1, 0.7, "n"),
        '{"sanction_flag":1,"notes":null}': (1, 0.3, None),
        '{"sanction_flag":1,"notes":5}': (0, 0.3, None),
        '{"sanction_flag":"x","political_risk_score":0.7}': (0, 0.3, None),
        "?": (0, 0.3, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "answer string")
    got = {r.answer: (r.sanction_flag, r.political_risk_score, r.notes) for r in feature_json(df, "answer", POLITICAL_ANSWER).collect()}
    assert got == cases
    index = {'{"global_risk":0.6,"timestamp":"2024-01"}': (0.6, "2024-01"), "{}": (0.2, "2025-05"), "x": (0.2, "2025-05"),
             '{"global_risk":0.6}': (0.6, "2025-05")}
    df = spark.createDataFrame([(k,) for k in index], "answer string")
    got = {r.answer: (r.global_risk, r.timestamp) for r in feature_json(df, "answer", pressure_answer("2025-05")).collect()}
    assert got == index


def test_trade_answers(spark):
    edge = {"exporter": "A", "importer": "B", "trade_value_usd": "12.5", "timestamp": "2024-01"}
    good = {
        json.dumps({"inventory_days": 12, "edges": [edge, {"exporter": "A"}]}): (12.0, 5.0, 1),
        "{}": (30.0, 5.0, 0),
        "unparsable": (30.0, 5.0, 0),
        '{"past_delay_days":"7"}': (30.0, 7.0, 0),
    }
    bad = ['{"inventory_days":"x"}', '{"inventory_days":null}', '{"edges":null}']
    df = spark.createDataFrame([(k,) for k in [*good, *bad]], "answer string")
    accepted, rejected = trade_json(df, "answer")
    assert {r.answer: (r.inventory_days, r.past_delay_days, len(r.edges)) for r in accepted.collect()} == good
    assert sorted(r.answer for r in rejected.collect()) == sorted(bad)


def test_edges_drop_alone(spark):
    edges = [
        {"exporter": "A", "importer": "B", "trade_value_usd": 1, "timestamp": "2024-01", "extra": 1},
        {"exporter": "A", "importer": "B", "trade_value_usd": "2.5", "timestamp": "2024-02"},
        {"exporter": "A", "importer": "B", "trade_value_usd": "much", "timestamp": "2024-02"},
        {"exporter": 7, "importer": "B", "trade_value_usd": 1, "timestamp": "2024-02"},
        {"exporter": "A", "trade_value_usd": 1, "timestamp": "2024-02"},
        {"exporter": "A", "importer": None, "trade_value_usd": 1, "timestamp": "2024-02"},
        "text",
    ]
    df = spark.createDataFrame([("r", json.dumps(edges)), ("none", "[]"), ("bad", "x")], "request_id string, edges string")
    assert sorted((r.request_id, r.trade_value_usd) for r in edges_valid(df).collect()) == [("r", 1.0), ("r", 2.5)]


def test_requests(spark, tmp_path):
    lines = [
        {"request_id": "1", "component_type": "c", "seller_location": "s", "import_location": "i", "additional_factors": {"priority": "high"}},
        {"request_id": "2", "component_type": "c", "seller_location": "s", "import_location": "i", "seller_name": "n"},
        {"request_id": "3", "component_type": "c", "seller_location": "s"},
    ]
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    accepted, rejected = read_requests(spark, str(path))
    got = {r.request_id: (r.seller_name, r.additional_factors) for r in accepted.collect()}
    assert got == {"1": (None, {"priority": "high"}), "2": ("n", {})}
    assert [r.request_id for r in rejected.collect()] == ["3"]


def test_rejected_requests_keep_reason_and_text(spark, tmp_path):
    good = '{"request_id":"1","created_at":"never","component_type":"c","seller_location":"s","import_location":"i"}'
    bad = ['{"request_id":"2","component_type":"c', "no json", '{"request_id":"3","seller_location":"s"}', "[1, 2]", "{}"]
    path = tmp_path / "in.json"
    path.write_text("\n".join([good, *bad]))
    accepted, rejected = read_requests(spark, str(path))
    assert [(r.request_id, r.created_at) for r in accepted.collect()] == [("1", None)]
    got = sorted((r.reason, r.raw_line or "") for r in rejected.collect())
    assert got == sorted([
        ("malformed", bad[0]), ("malformed", bad[1]), ("malformed", bad[3]),
        ("missing component_type, import_location", ""), ("missing component_type, seller_location, import_location", ""),
    ])


def test_query_fan_out(spark):
    df = spark.createDataFrame(
        [("1", "Chip", "Hsinchu", "LA", "TSMC"), ("2", "Chip", "X", "X", None)],
        "request_id string, component_type string, seller_location string, import_location string, seller_name string")
    rows = search_queries(df).collect()
    assert len(rows) == 20
    first = {(r.request_id, r.query_no): r.query for r in rows}
    assert first[("1", 1)] == "Chip TSMC Hsinchu strike OR protest OR stoppage"
    assert first[("1", 10)] == "TSMC LA port congestion OR customs backlog"
    assert first[("2", 9)] == " X port congestion OR customs backlog"
    required, any_of = query_terms(F.col("query"))
    terms = search_queries(df).where("request_id = '1' and query_no = 10").select(required.alias("r"), any_of.alias("a")).first()
    assert set(terms.r) == {"tsmc", "la", "port", "backlog"} and set(terms.a) == {"congestion", "customs"}


@pytest.mark.parametrize("hot", [100_000, 2])
def test_mention_match_against_brute_force(spark, monkeypatch, hot):
    import random
    import re

    import laneward.operators.mentions as mentions

    monkeypatch.setattr(mentions, "HOT_TERM", hot)
    rnd = random.Random(1)
    words = [f"w{n}" for n in range(12)]
    docs = [(n, " ".join(rnd.choices(words, k=rnd.randrange(0, 8))) + ", The end") for n in range(200)]
    queries = ["w1 w2", "W3 w4 OR w5", "w6 OR w7 OR w8", "w1 absent", "the w2 w3 OR w4 OR zzz", "zzz OR yyy", ""]
    doc_frame = spark.createDataFrame(docs, "doc_id long, text string")
    query_frame = spark.createDataFrame([(f"r{n}", q) for n, q in enumerate(queries)] + [("again", "w1 w2")], "request_id string, query string")
    matches = mention_match(doc_frame, query_frame)
    got = {(r["query"], r.doc_id) for r in matches.collect()}

    def holds(text, query):
        have = set(re.findall(r"\w+", text.lower()))
        alternatives = re.search(r"\S+(?: OR \S+)+", query)
        options = set(alternatives.group().lower().split(" or ")) if alternatives else set()
        needed = set(re.sub(r"\S+(?: OR \S+)+", " ", query).lower().split())
        return bool(needed or options) and needed <= have and (not options or bool(options & have))

    want = {(q, n) for n, t in docs for q in queries if holds(t, q)}
    assert got == want
    by_request = requests_of_matches(query_frame, matches)
    assert by_request.where("request_id = 'again'").count() == sum(q == "w1 w2" for q, _ in want)


def test_pairs_of_few_queries_are_not_shuffled(spark, monkeypatch):
    import laneward.operators.mentions as mentions

    docs = [(1, "the port is shut"), (1, "a strike"), (2, "the strike"), (None, "port of call"), (None, "the end"), (3, None), (4, "calm")]
    doc_frame = spark.createDataFrame(docs, "doc_id long, text string")
    free = [("a", "the OR port OR strike"), ("a", "strike OR shut"), ("b", "port OR call"), (None, "calm OR end")]
    want = {("a", 1), ("a", 2), ("a", None), ("b", 1), ("b", None), (None, 4), (None, None)}

    def frame(rows):
        return spark.createDataFrame(rows, "request_id string, query string")

    def found(rows):
        return requests_of_matches(frame(rows), mention_match(doc_frame, frame(rows)))

    monkeypatch.setattr(mentions, "FEW_PAIRS", 1)
    got = found(free)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the words by document; before, the pairs were shuffled twice, after a task had told apart those of many words
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "doc_id" in line]
    assert len(shuffled) == 1 and "Exchange hashpartitioning(doc_id" in shuffled[0]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # with words that a query requires, and many lookups: the same, in many tasks
    mixed = [*free, ("c", "the strike OR shut OR strike"), ("d", "port end"), ("e", "the")]
    want |= {("c", 1), ("c", 2), ("e", 1), ("e", 2)}
    monkeypatch.setattr(mentions, "TASK_PAIRS", 3)
    assert sorted(map(str, map(tuple, found(mixed).collect()))) == sorted(map(str, want))
    monkeypatch.setattr(mentions, "is_small", lambda *a: False)
    assert sorted(map(str, map(tuple, found(mixed).collect()))) == sorted(map(str, want))


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert load_state(spark, path) is None
    frame = lambda n: spark.createDataFrame([("x", float(n), 0.0, 0.0)], "feature string, count double, mean double, M2 double")
    assert save_state(frame(1), path) == 1
    assert save_state(frame(2), path) == 2
    assert load_state(spark, path).first()["count"] == 2.0
    assert load_state(spark, path, before=2).first()["count"] == 1.0
    save_state(frame(5), path, version=2)
    assert load_state(spark, path).first()["count"] == 5.0
    (tmp_path / "state" / "version=9").mkdir()  # a write that did not finish
    assert load_state(spark, path).first()["count"] == 5.0
