"""The whole analysis from requests: places, reuse, answers, weather, features, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.functions.text import lane_key
from laneward.operators.joins import lookup_join
from laneward.operators.locate import resolve_pair
from laneward.operators.reuse import reuse_features
from laneward.operators.scoring import FeatureSpec
from laneward.plans.analyze import analyze
from laneward.session import cut_lineage
from laneward.sources.answers import NEWS_ANSWER, POLITICAL_ANSWER, feature_json, pressure_answer, trade_json
from laneward.sources.payloads import weather_flags


def analyze_requests(
    requests: DataFrame,
    answers: DataFrame,
    weather: DataFrame,
    month: str,
    gazetteer: DataFrame | None = None,
    weights: DataFrame | Sequence[FeatureSpec] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) requests.

    requests: request_id, created_at, component_type, seller_location,
    import_location, seller_name and more to carry. answers: request_id and the
    answer texts trade, news, political and pressure; a request without a row has
    empty answers. weather: (lat, lon, payload), one row per place.

    A place that cannot be resolved has the weather of (0, 0). Requests of one
    lane within the reuse time take the news answer of the first of them. A trade
    answer that cannot be used rejects its request. ``scored`` keeps the columns
    of the requests, so that reports carry their inputs. Places, weather and lanes
    meet the requests by joins on distinct keys, and rows stay one per request.
    """
    lane = lane_key(*(F.col(c) for c in ("component_type", "seller_location", "import_location", "seller_name")))
    # the requests are derived once, and so is the source of each; every answer text is decoded once
    rows = cut_lineage(requests.withColumn("lane", lane))
    source = cut_lineage(reuse_features(rows).select("request_id", F.col("source_request_id").alias("_source")))
    texts = answers.select(F.col("request_id").alias("_source"), "news")
    news = feature_json(lookup_join(source, texts, "_source", F.col("request_id")), "news", NEWS_ANSWER).drop("news", "_source")

    flags = weather_flags(weather, ["lat", "lon"]).select(F.struct("lat", "lon").alias("_place"), "weather_anomaly_7d")
    placed = resolve_pair(rows, gazetteer=gazetteer)
    place = F.struct(F.coalesce("seller_lat", F.lit(0.0)).alias("lat"), F.coalesce("seller_lon", F.lit(0.0)).alias("lon"))
    placed = lookup_join(placed.withColumn("_place", place), flags, "_place", F.col("request_id")).drop("_place")

    asked = placed.join(answers.select("request_id", "trade", "political", "pressure"), "request_id", "left")
    accepted, _ = trade_json(asked, "trade")
    _, rejected = trade_json(rows.select("request_id").join(answers.select("request_id", "trade"), "request_id", "left"), "trade")
    decoded = feature_json(accepted, "political", POLITICAL_ANSWER)
    decoded = feature_json(decoded, "pressure", pressure_answer(month)).drop("trade", "political", "pressure", "timestamp")
    return analyze(decoded, [news], weights=weights), rejected.select("request_id")
