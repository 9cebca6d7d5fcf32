"""Trailing mention features of a stream: windows that slide by a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.operators.features import NEWS_DAYS, TONE_DAYS


def news_features_stream(mentions: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(lane, as_of, news_vol_7d, neg_tone_frac_3d, strike_flag_7d) per lane and day.

    mentions: streaming (lane, mention_id, ts TIMESTAMP, negative, strike). A
    window is (as_of - 7 days, as_of]; it is given out once the watermark has
    passed it, and rows later than that are dropped. A mention counts once in
    each window however often and however far apart it is seen: the first
    stateful aggregation keeps one row per mention and window, the second adds
    them up; both add up each task's rows before they are shuffled.
    """
    # windows are closed on the left; one microsecond makes them closed on the right
    timed = mentions.withColumn("at", F.col("ts") - F.expr("interval 1 microsecond"))
    windowed = timed.withWatermark("at", lateness).select(
        "lane", "mention_id", "at", "negative", "strike", F.window("at", f"{NEWS_DAYS} days", "1 day").alias("w")
    )
    recent = F.col("at") >= F.col("w.end") - F.expr(f"interval {TONE_DAYS} days")
    once = windowed.groupBy("lane", "mention_id", "w").agg(
        F.max(recent.cast("int")).alias("_recent"),
        F.max((recent & F.col("negative")).cast("int")).alias("_negative"),
        F.max(F.col("strike").cast("int")).alias("_strike"),
    )
    totals = once.groupBy("lane", "w").agg(
        F.count(F.lit(1)).cast("int").alias("news_vol_7d"),
        F.sum("_recent").alias("_recent"),
        F.sum("_negative").alias("_negative"),
        F.max("_strike").alias("strike_flag_7d"),
    )
    return totals.select(
        "lane",
        F.col("w.end").alias("as_of"),
        "news_vol_7d",
        F.coalesce(F.try_divide("_negative", "_recent"), F.lit(0.0)).alias("neg_tone_frac_3d"),
        F.coalesce("strike_flag_7d", F.lit(0)).alias("strike_flag_7d"),
    )
