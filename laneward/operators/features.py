"""Features of a request: mentions, weather, trade; and reuse by as-of lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneward.operators.ordered import last_known, running_sums
from laneward.session import cut_lineage

NEWS_DAYS = 7
TONE_DAYS = 3


def mention_steps(mentions: DataFrame, id_col: str = "mention_id") -> DataFrame:
    """(lane, at, n, strike, recent, negative): changes of what a trailing window holds.

    A mention may be seen many times; a window holds it once while any sighting is
    in it. Each sighting therefore counts from its time until its window ends or
    the next one of the same mention begins: n and strike over NEWS_DAYS, recent
    and negative over TONE_DAYS. Sightings without a time count nowhere.
    """
    seen = (
        mentions.where("ts IS NOT NULL")
        .groupBy("lane", F.col(id_col).alias("_id"), F.col("ts").cast("timestamp").alias("ts"))
        .agg(F.max("negative").alias("_neg"), F.max("strike").alias("_strike"))
    )
    later = Window.partitionBy("lane", "_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    kinds = {
        "n": (F.lit(True), NEWS_DAYS),
        "strike": (F.coalesce("_strike", F.lit(False)), NEWS_DAYS),
        "recent": (F.lit(True), TONE_DAYS),
        "negative": (F.coalesce("_neg", F.lit(False)), TONE_DAYS),
    }
    ends = {
        f"_end_{k}": F.least(F.col("ts") + F.make_interval(days=F.lit(days)), F.min(F.when(flag, F.col("ts"))).over(later))
        for k, (flag, days) in kinds.items()
    }

    def step(at: str, sign: int, names: Sequence[str]) -> Column:
        return F.struct(
            F.col(at).alias("at"),
            *[(F.when(kinds[k][0], sign).otherwise(0) if k in names else F.lit(0)).cast("long").alias(k) for k in kinds],
        )

    steps = [step("ts", 1, list(kinds)), *(step(f"_end_{k}", -1, [k]) for k in kinds)]
    return seen.withColumns(ends).select("lane", F.inline(F.array(*steps)))


def news_features(
    requests: DataFrame, mentions: DataFrame, grain: str | None = None, buckets: int | None = None
) -> DataFrame:
    """(request_id, news_vol_7d, neg_tone_frac_3d, strike_flag_7d).

    requests: request_id, lane, created_at. mentions: lane, mention_id, ts,
    negative, strike (relevant ones only). A window is (created_at - N days,
    created_at]; a mention seen several times in it counts once.

    What a window holds at a time is a running total of the lane's steps, so the
    work is linear in mentions plus requests: no pair of a request and a mention
    is ever formed, and a hot lane is split by range. Where all request times are
    multiples of ``grain`` ("day", "hour"), steps are first added up per lane and
    grain before they are shuffled.
    """
    at = F.col("at")
    if grain is not None:
        floor = F.date_trunc(grain, at)
        at = F.when(floor == at, at).otherwise(floor + F.expr(f"interval 1 {grain}"))
    counts = ["n", "strike", "recent", "negative"]
    steps = (
        mention_steps(mentions)
        .groupBy("lane", at.alias("at"))
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    timeline = steps.select(
        "lane",
        "at",
        F.lit(0).alias("side"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        *counts,
    ).unionByName(
        requests.select(
            "lane",
            F.col("created_at").cast("timestamp").alias("at"),
            F.lit(1).alias("side"),
            "request_id",
            *[F.lit(0).cast("long").alias(c) for c in counts],
        )
    )
    # read for the bounds, the summaries and the rows; the windows over mentions run once
    totals = running_sums(cut_lineage(timeline), ["lane"], ["at", "side", "request_id"], counts, buckets)
    return totals.where("side = 1").select(
        "request_id",
        F.col("n").cast("int").alias("news_vol_7d"),
        F.coalesce(F.try_divide("negative", "recent"), F.lit(0.0)).alias("neg_tone_frac_3d"),
        (F.col("strike") > 0).cast("int").alias("strike_flag_7d"),
    )


MIN_DAYS = 5
DEVIATIONS = 1.5
# a day exactly on the limit is no anomaly, whatever the order of summation
TIE = 1e-9


def _beyond(low: Column, high: Column, mean: Column, variance: Column) -> Column:
    reach = F.greatest(high - mean, mean - low)
    return reach * reach > DEVIATIONS * DEVIATIONS * variance * (1 + TIE)


def weather_anomaly(daily: DataFrame, by: Sequence[str] = ("lane",)) -> DataFrame:
    """(by, weather_anomaly_7d) from daily rows (by, provider, day_no, temp[, malformed]).

    One pass: the farthest day is the minimum or the maximum. A malformed row
    clears the flag of its whole payload; either provider can raise the flag.
    """
    broken = F.max("malformed") if "malformed" in daily.columns else F.lit(False)
    per_provider = daily.groupBy(*by, "provider").agg(
        F.count("temp").alias("n"),
        F.avg("temp").alias("mean"),
        F.var_pop("temp").alias("variance"),
        F.min("temp").alias("low"),
        F.max("temp").alias("high"),
        broken.alias("broken"),
    )
    fires = (
        (F.col("n") >= MIN_DAYS)
        & ~F.col("broken")
        & _beyond(F.col("low"), F.col("high"), F.col("mean"), F.col("variance"))
    )
    return (
        per_provider.withColumn("fires", F.coalesce(fires, F.lit(False)).cast("int"))
        .groupBy(*by)
        .agg(F.max("fires").alias("weather_anomaly_7d"))
    )


def weather_sums(days: Column) -> Column:
    """(n, base, s, q, low, high, broken) of an array of days with ``temp``, in one pass.

    Sums are taken around the first temperature, so that squares do not cancel.
    """
    nothing = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0).alias("n"),
        nothing.alias("base"),
        F.lit(0.0).alias("s"),
        F.lit(0.0).alias("q"),
        nothing.alias("low"),
        nothing.alias("high"),
        F.lit(False).alias("broken"),
    )

    def add(acc: Column, day: Column) -> Column:
        base = F.coalesce(acc["base"], day["temp"])
        off = F.coalesce(day["temp"] - base, F.lit(0.0))
        return F.struct(
            (acc["n"] + 1).alias("n"),
            base.alias("base"),
            (acc["s"] + off).alias("s"),
            (acc["q"] + off * off).alias("q"),
            F.least(acc["low"], day["temp"]).alias("low"),
            F.greatest(acc["high"], day["temp"]).alias("high"),
            (acc["broken"] | day["temp"].isNull()).alias("broken"),
        )

    return F.aggregate(days, start, add)


def weather_flag_column(sums: Column) -> Column:
    """The same test on the sums of one payload: no shuffle for payload tables."""
    shift = F.try_divide(sums["s"], sums["n"])
    variance = F.try_divide(sums["q"], sums["n"]) - shift * shift
    fires = _beyond(sums["low"], sums["high"], sums["base"] + shift, variance)
    return F.when((sums["n"] >= MIN_DAYS) & ~sums["broken"] & fires, 1).otherwise(0)


def trade_signals(shipments: DataFrame) -> DataFrame:
    """(lane, inventory_days, past_delay_days) from (lane, quantity, ordered_at, shipped_at).

    Inventory stands for the mean quantity on hand per shipment; delay is the
    mean number of days late, where early counts as none.
    """
    late = F.greatest(F.date_diff("shipped_at", "ordered_at"), F.lit(0))
    return shipments.groupBy("lane").agg(
        F.avg("quantity").alias("inventory_days"), F.avg(late).alias("past_delay_days")
    )


def stock_days(moves: DataFrame, days: int = 30, buckets: int | None = None) -> DataFrame:
    """(lane, day, stock, daily_outflow, stock_days) for each day on which a lane's goods moved.

    moves: lane, day, inflow, outflow; several rows of a day are added up, null
    counts as nothing. Stock is all inflow less all outflow up to and with the day.
    The baseline is the mean outflow of the last ``days`` calendar days, those without
    movement included, or of the days since the lane's first movement if they are
    fewer; stock_days is how long the stock, if there is any, lasts at that rate, and
    null where nothing left in that time.

    Both sums are running totals of steps: an outflow enters the trailing sum on its
    day and leaves it ``days`` later, so no window is formed and a lane of very many
    days is split by range.
    """
    amount = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    daily = moves.where("day IS NOT NULL").groupBy("lane", F.col("day").cast("date").alias("day")).agg(
        amount("inflow").alias("inflow"), amount("outflow").alias("outflow")
    )
    entering = daily.select(
        "lane", "day", F.lit(1).alias("side"), (F.col("inflow") - F.col("outflow")).alias("stock"), F.col("outflow").alias("recent")
    )
    leaving = daily.select(
        "lane", F.date_add("day", days).alias("day"), F.lit(0).alias("side"), F.lit(0.0).alias("stock"), (-F.col("outflow")).alias("recent")
    )
    timeline = cut_lineage(entering.unionByName(leaving))
    totals = running_sums(timeline, ["lane"], ["day", "side"], ["stock", "recent"], buckets).where("side = 1")
    began = timeline.groupBy(F.col("lane").alias("of")).agg(F.min("day").alias("first"))
    dated = totals.join(began, F.col("lane").eqNullSafe(F.col("of")))
    rate = F.col("recent") / F.least(F.lit(days), F.date_diff("day", "first") + 1)
    lasts = F.try_divide(F.greatest("stock", F.lit(0.0)), rate)
    return dated.select("lane", "day", "stock", rate.alias("daily_outflow"), lasts.alias("stock_days"))


def trade_flow(edges: DataFrame, trailing_months: int = 3) -> DataFrame:
    """Monthly value per exporter and importer against its trailing mean.

    edges: exporter, importer, trade_value_usd, timestamp 'YYYY-MM'. The window
    runs over months that are already summed up, so its groups are calendars.
    """
    monthly = edges.groupBy("exporter", "importer", F.col("timestamp").alias("month")).agg(
        F.sum("trade_value_usd").alias("value_usd")
    )
    trailing = (
        Window.partitionBy("exporter", "importer")
        .orderBy("month")
        .rowsBetween(-trailing_months, -1)
    )
    return monthly.withColumn("baseline_usd", F.avg("value_usd").over(trailing)).withColumn(
        "ratio", F.try_divide("value_usd", "baseline_usd")
    )


def trade_totals(edges: DataFrame) -> DataFrame:
    """Value by exporter and month, by exporter, and overall."""
    return edges.rollup("exporter", F.col("timestamp").alias("month")).agg(
        F.sum("trade_value_usd").alias("value_usd"), F.count(F.lit(1)).alias("n_edges")
    )


def asof_features(
    requests: DataFrame,
    feats: DataFrame,
    tolerance_s: int = 900,
    computed: str = "computed_at",
    buckets: int | None = None,
) -> DataFrame:
    """Newest feature row of the lane at or before each request, if still fresh.

    requests: request_id, lane, created_at. feats: lane, computed_at and any
    feature columns. A row whose age has reached the tolerance is too old.
    """
    payload = [c for c in feats.columns if c != "lane"]
    id_type = requests.schema["request_id"].dataType
    # copies collapse before they are shuffled; of several rows at one time the largest counts
    newest = feats.groupBy("lane", F.col(computed).cast("timestamp").alias("at")).agg(
        F.max(F.struct(*payload)).alias("row")
    )
    timeline = newest.select(
        "lane", "at", F.lit(0).alias("side"), F.lit(None).cast(id_type).alias("request_id"), "row"
    ).unionByName(
        requests.select(
            "lane",
            F.col("created_at").cast("timestamp").alias("at"),
            F.lit(1).alias("side"),
            "request_id",
            F.lit(None).cast(newest.schema["row"].dataType).alias("row"),
        )
    )
    found = last_known(timeline, ["lane"], ["at", "side", "request_id"], "row", buckets).where("side = 1")
    age = F.unix_micros("at") - F.unix_micros(F.col(f"row.{computed}").cast("timestamp"))
    fresh = F.when(age < tolerance_s * 1_000_000, F.col("row"))
    return found.select("request_id", "lane", F.col("at").alias("created_at"), fresh.alias("row")).select(
        "request_id", "lane", "created_at", *[F.col(f"row.{c}").alias(c) for c in payload]
    )
