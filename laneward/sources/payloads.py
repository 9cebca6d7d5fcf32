"""Scans over raw answers: weather, search results, pages, edges, geocoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.functions.text import PAGE_TEXT_CAP, page_text_column
from laneward.functions.variant import field, is_kind, number, parsed
from laneward.operators.features import weather_flag_column, weather_sums

# Provider, path of the day list, object of a day, temperature in it
WEATHER_SHAPES = [
    ("openweather", "$.daily", "temp", "day"),
    ("weatherapi", "$.forecast.forecastday", "day", "avgtemp_c"),
]


def weather_daily(raw: DataFrame, by: Sequence[str] = ("lane",), payload: str = "payload") -> DataFrame:
    """(by, provider, day_no, temp, malformed) rows of both payload shapes.

    Days without the holder object are skipped; a day whose holder has no
    numeric temperature is malformed.
    """
    value = raw.select(*by, parsed(F.col(payload)).alias("_v"))
    parts = [
        value.select(
            *by,
            F.lit(provider).alias("provider"),
            F.posexplode(field(F.col("_v"), path, "array<variant>")).alias("_pos", "_day"),
        )
        .select(
            *by,
            "provider",
            (F.col("_pos") + 1).alias("day_no"),
            field(F.col("_day"), f"$.{holder}").alias("_held"),
            number(F.col("_day"), f"$.{holder}.{leaf}").alias("temp"),
        )
        .where("_held is not null")
        .select(*by, "provider", "day_no", "temp", F.col("temp").isNull().alias("malformed"))
        for provider, path, holder, leaf in WEATHER_SHAPES
    ]
    return parts[0].unionByName(parts[1])


def _held_days(payload: Column, path: str, holder: str, leaf: str) -> Column:
    """Days of one shape that have the holder object, as an array of (temp, has)."""
    days = F.transform(
        field(payload, path, "array<variant>"),
        lambda d: F.struct(
            number(d, f"$.{holder}.{leaf}").alias("temp"), field(d, f"$.{holder}").isNotNull().alias("has")
        ),
    )
    return F.filter(days, lambda d: d["has"])


def weather_flags(raw: DataFrame, by: Sequence[str] = ("lane",), payload: str = "payload") -> DataFrame:
    """(by, weather_anomaly_7d), one row per payload, computed inside the row."""
    value = raw.select(*by, parsed(F.col(payload)).alias("_v"))
    sums = {
        f"_s{n}": weather_sums(_held_days(F.col("_v"), *shape)) for n, (_, *shape) in enumerate(WEATHER_SHAPES)
    }
    flags = [weather_flag_column(F.col(s)) for s in sums]
    return value.withColumns(sums).select(*by, F.greatest(*flags).alias("weather_anomaly_7d"))


RESULTS_PER_QUERY = 6


def search_links(
    raw: DataFrame,
    by: Sequence[str] = ("request_id", "query_no"),
    num: int | None = RESULTS_PER_QUERY,
    payload: str = "payload",
) -> DataFrame:
    """(by, rank, link): non-empty links among the first ``num`` results of a query, or all of them."""
    results = field(parsed(F.col(payload)), "$.organic_results", "array<variant>")
    return (
        raw.select(*by, F.posexplode(results).alias("pos", "item"))
        .where(F.lit(True) if num is None else F.col("pos") < num)
        .select(*by, (F.col("pos") + 1).alias("rank"), field(F.col("item"), "$.link", "string").alias("link"))
        .where("link is not null and link <> ''")
    )


def page_filter(pages: DataFrame) -> DataFrame:
    """Fetched pages that answered 200 with an HTML content type."""
    return pages.where((F.col("status") == 200) & F.contains(F.col("content_type"), F.lit("text/html")))


def page_text(pages: DataFrame, html: str = "html", cap: int | None = PAGE_TEXT_CAP) -> DataFrame:
    """Add ``text``: the visible text of the whole page, then cut to ``cap``."""
    return pages.where(F.col(html).isNotNull()).withColumn("text", page_text_column(F.col(html), cap))


def _edge_fields(edge: Column) -> dict[str, Column]:
    """The four fields of an edge; one of the wrong type is null."""

    def text(name: str) -> Column:
        return F.when(is_kind(field(edge, f"$.{name}"), "STRING"), field(edge, f"$.{name}", "string"))

    return {
        "exporter": text("exporter"),
        "importer": text("importer"),
        "trade_value_usd": field(edge, "$.trade_value_usd", "double"),
        "timestamp": text("timestamp"),
    }


def valid_edges(edges: Column) -> Column:
    """Edges of an array variant that have all four fields, as structs."""
    items = F.transform(edges, lambda e: F.struct(*[c.alias(n) for n, c in _edge_fields(e).items()]))
    return F.filter(
        items,
        lambda e: e["exporter"].isNotNull()
        & e["importer"].isNotNull()
        & e["trade_value_usd"].isNotNull()
        & e["timestamp"].isNotNull(),
    )


def edges_valid(df: DataFrame, by: Sequence[str] = ("request_id",), edges: str = "edges") -> DataFrame:
    """Valid edges of a JSON array column, one per row; an invalid edge drops out alone."""
    listed = field(parsed(F.col(edges)), "$", "array<variant>")
    items = df.select(*by, F.explode(listed).alias("_edge"))
    fields = F.struct(*[c.alias(n) for n, c in _edge_fields(F.col("_edge")).items()])
    # a generator again, so that the filter does not extract every field twice
    return items.select(*by, F.inline(F.array(fields))).dropna(
        subset=["exporter", "importer", "trade_value_usd", "timestamp"]
    )


def _coordinate(item: Column, long_name: str, short_name: str) -> Column:
    """The long field unless it is absent, null, 0 or empty; then the short one."""
    first = field(item, f"$.{long_name}", "string")
    first_value = field(item, f"$.{long_name}", "double")
    empty = (
        first.isNull()
        | (first == "")
        | (first == "false")
        | (~is_kind(field(item, f"$.{long_name}"), "STRING") & (F.coalesce(first_value, F.lit(1.0)) == 0))
    )
    value = F.when(empty, field(item, f"$.{short_name}", "double")).otherwise(first_value)
    return F.when(value != 0, value)


def _filled(value: Column) -> Column:
    """The value unless it is null, an empty list or an empty object."""
    shape = F.schema_of_variant(value)
    void = value.isNull() | (shape == "VOID") | (shape == "ARRAY<VOID>") | (shape == "OBJECT<>")
    listed = F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(-1))
    return F.when(~void | (listed > 0), value)


def geocode_payload(raw: DataFrame, by: Sequence[str] = ("address",), payload: str = "payload") -> DataFrame:
    """(by, lat, lon) of a geocoder answer; both null when it holds none."""
    value = parsed(F.col(payload))
    results = F.coalesce(_filled(field(F.col("_v"), "$.copResults")), _filled(field(F.col("_v"), "$.results")))
    item = (
        F.when(is_kind(F.col("_v"), "ARRAY"), field(F.col("_v"), "$[0]"))
        .when(is_kind(F.col("_r"), "ARRAY"), field(F.col("_r"), "$[0]"))
        .when(is_kind(F.col("_r"), "OBJECT"), F.col("_r"))
        .otherwise(F.col("_v"))
    )
    lat = _coordinate(F.col("_item"), "latitude", "lat")
    lon = _coordinate(F.col("_item"), "longitude", "lng")
    both = lat.isNotNull() & lon.isNotNull()
    return (
        raw.select(*by, value.alias("_v"))
        .withColumn("_r", results)
        .withColumn("_item", item)
        .select(*by, F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))
    )
