"""Places: free text to coordinates and to cities, first match in list order."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.dims import CITIES, COUNTRY_CITY, GAZETTEER, small_rows
from laneward.operators.joins import lookup_join, small_or_merged
from laneward.session import cut_lineage


def _literal(rows: Sequence[Sequence], fields: str) -> Column:
    """Rows as one constant array of structs; ``fields`` is 'name:type,...'."""
    names = [f.split(":")[0] for f in fields.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return F.from_json(F.lit(text), f"array<struct<{fields}>>")


def _starting_key(keys: Sequence[str]) -> str:
    """Pattern that captures, at each position, the first key starting there.

    Keys are grouped by first letter, which keeps their order where it matters
    and spares most comparisons.
    """
    groups: dict[str, list[str]] = {}
    for key in keys:
        groups.setdefault(key[0], []).append(re.escape(key[1:]))
    choices = [f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items()]
    return "(?s)(?=(" + "|".join(choices) + "))"


def _first_match(text: str, rows: Sequence[Sequence], fields: str, both_ways: bool) -> Column:
    """First of ``rows`` whose leading key is inside the text column (or the
    text inside the key).

    One pattern finds, at each position of the text, the first key in list
    order that starts there; the smallest list position among these is the
    first key inside the text. The opposite direction is looked at only if the
    text occurs in some key at all.
    """
    if not rows:
        names = [f.split(":") for f in fields.split(",")]
        return F.struct(*[F.lit(None).cast(kind).alias(n) for n, kind in names])
    listed = [row[0] for row in rows]
    keys = F.from_json(F.lit(json.dumps(listed)), "array<string>")
    found = F.regexp_extract_all(text, F.lit(_starting_key([k for k in listed if k])), 1)
    place = F.array_min(F.transform(found, lambda key: F.array_position(keys, key)))
    if "" in listed:  # an empty key is inside every text
        place = F.least(place, F.when(F.col(text).isNotNull(), F.array_position(keys, F.lit(""))))
    if both_ways:
        holds = F.transform(keys, lambda key: F.contains(key, F.col(text)))
        short = F.length(text) <= max(map(len, listed))
        around = F.when(
            short & F.contains(F.lit("\n".join(listed)), F.col(text)), F.array_position(holds, F.lit(True))
        )
        place = F.least(place, F.when(around > 0, around))
    return F.try_element_at(_literal(rows, fields), place.cast("int"))


def _address(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def geocode_lookup(df: DataFrame, addr_col: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Add place_key, lat, lon of the first gazetteer entry that matches.

    Entry and address match when either text contains the other. A short
    gazetteer is an ordered literal: one projection, no join. A long one takes
    ``_geocode_by_substring``, which gives the same result by equi joins.
    """
    if gazetteer is None:
        rows = GAZETTEER
    else:
        found = small_rows(gazetteer.select("priority", "key", "lat", "lon"))
        if found is None:
            return _geocode_by_substring(df, addr_col, gazetteer)
        kept = [r for r in found if r["key"] is not None]
        # as Spark sorts: nulls first, column by column
        rows = [tuple(r)[1:] for r in sorted(kept, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])]
    if not rows:
        empty = F.lit(None)
        return df.withColumns(
            {"place_key": empty.cast("string"), "lat": empty.cast("double"), "lon": empty.cast("double")}
        )
    return (
        df.withColumn("_addr", _address(F.col(addr_col)))
        .withColumn("_hit", _first_match("_addr", rows, "key:string,lat:double,lon:double", True))
        .withColumns({"place_key": F.col("_hit.key"), "lat": F.col("_hit.lat"), "lon": F.col("_hit.lon")})
        .drop("_addr", "_hit")
    )


def _pieces(text: str, lengths: Column) -> Column:
    """Every distinct substring of a text whose length is in ``lengths``."""
    col = F.col(text)
    fitting = F.filter(lengths, lambda n: n <= F.length(col))
    return F.array_distinct(
        F.flatten(
            F.transform(
                fitting,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substring(col, i, n)
                ),
            )
        )
    )


def _first_by_substring(texts: DataFrame, entries: DataFrame, both_ways: bool) -> DataFrame:
    """(_text, _hit) of each distinct _text that an entry (priority, key, ...) matches: the first entry.

    "Key inside text" is an equality between a key and a substring of the text,
    "text inside key" one between the text and a substring of a key. Texts are cut
    at the lengths that keys have, keys at the lengths that texts have and only
    where a text is that short, so long keys are not cut everywhere. Each piece
    keeps only its first entry. Entries without a key match nothing. Pieces are many
    more than Spark expects of an explode, so no side is broadcast unless counted.
    """
    entry = F.struct("priority", *[c for c in entries.columns if c != "priority"])
    keys = entries.where("key IS NOT NULL").groupBy("key").agg(F.min(entry).alias("entry"))
    distinct = cut_lineage(texts.select("_text").where("_text IS NOT NULL").distinct())

    def lengths(frame: DataFrame, column: str) -> Column:
        # at most as many as the longest text has characters
        found = frame.select(F.length(column).alias("n")).distinct().collect()
        return F.array(*[F.lit(n) for n in sorted(r["n"] for r in found)]).cast("array<int>")

    # numbers in the order of the entries, so that pieces carry one number and not their entry
    keys = cut_lineage(keys.orderBy("entry").withColumn("number", F.monotonically_increasing_id()))
    key_lengths, text_lengths = lengths(keys, "key"), lengths(distinct, "_text")
    numbers = small_or_merged(keys.select("key", "number"))
    pieces = distinct.select("_text", F.explode(_pieces("_text", key_lengths)).alias("key"))
    hits = pieces.join(numbers, "key").select("_text", "number")
    if both_ways:
        inside = keys.select("number", F.explode(_pieces("key", text_lengths)).alias("_text"))
        first = inside.groupBy("_text").agg(F.min("number").alias("number"))
        hits = hits.unionByName(first.join(small_or_merged(distinct), "_text"))
    best = hits.groupBy("_text").agg(F.min("number").alias("number"))
    return best.join(small_or_merged(keys.select("number", F.col("entry").alias("_hit"))), "number").select("_text", "_hit")


def _geocode_by_substring(df: DataFrame, addr_col: str, gazetteer: DataFrame) -> DataFrame:
    """Exact two-way containment match against a gazetteer of any size, once per distinct address."""
    keyed = df.withColumn("_text", _address(F.col(addr_col)))
    best = _first_by_substring(keyed, gazetteer.select("priority", "key", "lat", "lon"), True)
    return (
        lookup_join(keyed, best, "_text", F.struct(*df.columns))
        .withColumns({"place_key": F.col("_hit.key"), "lat": F.col("_hit.lat"), "lon": F.col("_hit.lon")})
        .drop("_text", "_hit")
    )


def geocode_resolve(
    df: DataFrame,
    addr_col: str,
    provider_1: DataFrame,
    provider_2: DataFrame,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Coordinates from provider 1, else provider 2, else the gazetteer.

    Provider tables are (address, lat, lon) with one row per address.
    """
    tables = {
        n: p.select(F.col("address").alias(addr_col), F.struct("lat", "lon").alias(n))
        for n, p in (("_p1", provider_1), ("_p2", provider_2))
    }
    known = geocode_lookup(df.select(addr_col).distinct(), addr_col, gazetteer)
    local = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))
    places = (
        known.withColumn("_p3", local)
        .join(tables["_p1"], addr_col, "left")
        .join(tables["_p2"], addr_col, "left")
        .select(addr_col, F.coalesce("_p1", "_p2", "_p3").alias("_place"))
        .select(addr_col, F.col("_place.lat").alias("lat"), F.col("_place.lon").alias("lon"))
    )
    return lookup_join(df, places, addr_col, F.struct(*df.columns))


def resolve_pair(
    requests: DataFrame,
    provider_1: DataFrame | None = None,
    provider_2: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Seller and importer coordinates on one row."""

    def side(df: DataFrame, location: str, prefix: str) -> DataFrame:
        if provider_1 is None and provider_2 is None:
            # each distinct text is looked up once
            places = geocode_lookup(df.select(location).distinct(), location, gazetteer).drop("place_key")
            found = lookup_join(df, places, location, F.struct(*df.columns))
        else:
            empty = (provider_1 or provider_2).limit(0)
            found = geocode_resolve(df, location, provider_1 or empty, provider_2 or empty, gazetteer)
        return found.withColumnsRenamed({"lat": f"{prefix}_lat", "lon": f"{prefix}_lon"})

    return side(side(requests, "seller_location", "seller"), "import_location", "import")


def city_match(
    df: DataFrame,
    loc_col: str,
    out_col: str = "city_id",
    cities: DataFrame | None = None,
    country_city: DataFrame | None = None,
) -> DataFrame:
    """Add the city a location stands for: names by two-way containment, then
    country keys inside the location; '' if none. The text is not trimmed.

    Short lists become ordered literals, so the match is one projection. Longer
    ones take equi joins on substrings of the distinct locations, with the same
    result.
    """
    by_name = _entries(cities, ("priority", "name", "id"), [(name, id_) for id_, name, _, _ in CITIES], lower=True)
    by_country = _entries(country_city, ("priority", "key", "city_id"), COUNTRY_CITY, lower=False)
    rows = df.withColumn("_text", F.lower(loc_col))
    if isinstance(by_name, DataFrame) or isinstance(by_country, DataFrame):
        distinct = rows.select("_text").where("_text <> ''").distinct()
        spark = df.sparkSession
        fields = "priority int, key string, id string"
        found = distinct
        for out, entries, both_ways in (("_name", by_name, True), ("_country", by_country, False)):
            if not isinstance(entries, DataFrame):
                entries = spark.createDataFrame([(n, *e) for n, e in enumerate(entries, 1)], fields)
            best = _first_by_substring(distinct, entries, both_ways).withColumnRenamed("_hit", out)
            found = found.join(best.hint("merge"), "_text", "left")
        found = found.select("_text", F.coalesce("_name.id", "_country.id").alias("_city"))
        rows = lookup_join(rows, found, "_text", F.struct(*df.columns))
    else:
        name = _first_match("_text", by_name, "key:string,id:string", True)
        country = _first_match("_text", by_country, "key:string,id:string", False)
        rows = rows.withColumn("_city", F.coalesce(name["id"], country["id"]))
    city = F.when(F.coalesce("_text", F.lit("")) == "", F.lit("")).otherwise(F.coalesce("_city", F.lit("")))
    return rows.withColumn(out_col, city).drop("_text", "_city")


def _entries(
    table: DataFrame | None, names: tuple[str, str, str], built_in: Sequence[tuple], lower: bool
) -> DataFrame | list[tuple]:
    """(key, id) pairs in order if the table is short, else a frame (priority, key, id)."""
    if table is None:
        return [(k.lower() if lower else k, v) for k, v in built_in]
    priority, key, id_ = names
    text = F.lower(key) if lower else F.col(key)
    frame = table.select(F.col(priority).alias("priority"), text.alias("key"), F.col(id_).alias("id")).where(
        "key IS NOT NULL"
    )
    rows = small_rows(frame)
    return frame if rows is None else [tuple(r)[1:] for r in sorted(rows)]
