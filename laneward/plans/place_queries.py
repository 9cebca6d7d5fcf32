"""Queries of sources, texts, places and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneward.dims import CITIES, COUNTRY_CITY, GAZETTEER, GRAPH_EDGES, SEARCH_TEMPLATES, dims
from laneward.functions.text import lane_key, strip_fences
from laneward.operators import locate, mentions, news_path, ranking, routes
from laneward.operators.scoring import with_identity
from laneward.plans import warehouse as wh
from laneward.plans.registry import query, r6, values_sql
from laneward.session import cut_lineage, shared_folder
from laneward.sources import answers, payloads
from laneward.sources.requests import REQUEST_SCHEMA, requests_from, scan_requests

# ---------------------------------------------------------------------------
# Sources
# ---------------------------------------------------------------------------


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, c_mktsegment AS component_type, n_name AS seller_location,
       CASE WHEN o_orderstatus <> 'P' THEN c_name END AS import_location,
       CASE WHEN o_orderstatus = 'F' THEN c_name END AS seller_name,
       CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS priority,
       CAST(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS INTEGER) AS n_factors,
       o_orderstatus <> 'P' AS accepted
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def request_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as request JSON, read with the request schema."""
    customer = wh.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = wh.table(spark, sf, "nation").select("n_nationkey", "n_name")
    orders = wh.table(spark, sf, "orders")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    text = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("request_id"),
            F.col("c_mktsegment").alias("component_type"),
            F.col("n_name").alias("seller_location"),
            F.when(F.col("o_orderstatus") != "P", F.col("c_name")).alias("import_location"),
            F.when(F.col("o_orderstatus") == "F", F.col("c_name")).alias("seller_name"),
            F.when(
                F.col("o_totalprice") > 250000, F.create_map(F.lit("priority"), F.col("o_orderpriority"))
            ).alias("additional_factors"),
        )
    )
    read = rows.select(F.from_json(text, REQUEST_SCHEMA).alias("r")).select("r.*")
    accepted, rejected = requests_from(read)
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.select(
        "request_id",
        "component_type",
        "seller_location",
        "import_location",
        "seller_name",
        F.col("additional_factors")["priority"].alias("priority"),
        F.size("additional_factors").alias("n_factors"),
        "accepted",
    )


@query("""
SELECT o_orderkey AS order_no, CASE
         WHEN o_orderkey % 7 = 1 THEN 'malformed'
         WHEN o_orderkey % 7 = 2 THEN 'missing component_type, import_location'
         WHEN o_orderkey % 7 = 3 THEN 'missing import_location' END AS reason,
       CASE WHEN o_orderkey % 7 = 1 THEN '{"request_id":"' || o_orderkey || '","component_type":"' || o_orderpriority
            WHEN o_orderkey % 7 = 4 THEN '{"request_id":"' || o_orderkey || '","created_at":"no time","component_type":"' || o_orderpriority
              || '","seller_location":"s","import_location":"i"}' END AS raw_line
FROM orders""")
def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a request line, some cut short or incomplete, written as text and read by one scan."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 7
    start = F.concat(F.lit('{"request_id":"'), key.cast("string"), F.lit('"'))
    typed = F.concat(F.lit(',"component_type":"'), F.col("o_orderpriority"))
    seller, both = F.lit(',"seller_location":"s"}'), F.lit('","seller_location":"s","import_location":"i"}')
    line = (
        F.when(kind == 1, F.concat(start, typed))
        .when(kind == 2, F.concat(start, seller))
        .when(kind == 3, F.concat(start, typed, F.lit('"'), seller))
        .when(kind == 4, F.concat(start, F.lit(',"created_at":"no time"'), typed, both))
        .otherwise(F.concat(start, typed, both))
    )
    path = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    wh.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    rows = scan_requests(spark, path)
    # a malformed line gives no field, so its number is read from its text
    number = F.coalesce("request_id", F.regexp_extract("raw_line", r'"request_id":"(\d+)"', 1)).cast("long")
    return rows.select(number.alias("order_no"), "reason", "raw_line")


def _weather_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One answer per order line: days of both shapes, some without a temperature."""
    lines = wh.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    temps = [F.col("l_quantity") + k for k in range(5)]
    outlier = F.when(F.col("l_discount") > 0.05, F.col("l_quantity") + 40)
    day_a = [F.struct(F.struct(t.alias("day")).alias("temp")) for t in temps]
    # without an outlier the struct field is null and drops out of the JSON text
    day_a.append(F.struct(F.when(outlier.isNotNull(), F.struct(outlier.alias("day"))).alias("temp")))
    day_b = [F.struct(F.struct((t * 2).alias("avgtemp_c")).alias("day")) for t in temps[:4]]
    last_b = F.struct(F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice")).alias("avgtemp_c"))
    day_b.append(F.struct(last_b.alias("day")))
    shape_a = F.struct(F.array(*day_a).alias("daily"))
    shape_b = F.struct(F.struct(F.array(*day_b).alias("forecastday")).alias("forecast"))
    payload = F.when(F.col("l_returnflag") == "A", F.to_json(shape_a)).when(F.col("l_returnflag") == "N", F.to_json(shape_b))
    return lines.select(
        F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("lane"),
        payload.alias("payload"),
    )


WEATHER_ROWS = """
lines AS (
  SELECT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS lane, *
  FROM lineitem),
days AS (
  SELECT lane, 'openweather' AS provider, k AS day_no, l_quantity + k - 1 AS temp
  FROM lines, range(1, 6) t(k) WHERE l_returnflag = 'A'
  UNION ALL
  SELECT lane, 'openweather', 6, l_quantity + 40 FROM lines WHERE l_returnflag = 'A' AND l_discount > 0.05
  UNION ALL
  SELECT lane, 'weatherapi', k, (l_quantity + k - 1) * 2 FROM lines, range(1, 5) t(k) WHERE l_returnflag = 'N'
  UNION ALL
  SELECT lane, 'weatherapi', 5, CASE WHEN l_tax > 0.04 THEN l_extendedprice END FROM lines WHERE l_returnflag = 'N')"""


@query(f"WITH {WEATHER_ROWS} SELECT lane, provider, CAST(day_no AS INTEGER) AS day_no, round(temp, 6) AS temp, temp IS NULL AS malformed FROM days")
def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.weather_daily(_weather_payloads(spark, sf)).withColumn("temp", r6("temp"))


@query(f"""
WITH {WEATHER_ROWS}, flags AS (
  SELECT lane, provider, CASE WHEN count(temp) >= 5 AND count(*) = count(temp)
    AND power(greatest(max(temp) - avg(temp), avg(temp) - min(temp)), 2) > 2.25 * var_pop(temp) * (1 + 1e-9) THEN 1 ELSE 0 END AS f
  FROM days GROUP BY 1, 2)
SELECT l.lane, CAST(coalesce(f, 0) AS INTEGER) AS weather_anomaly_7d FROM lines l LEFT JOIN flags USING (lane)""")
def weather_flags(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.weather_flags(_weather_payloads(spark, sf))


def _page_results(spark: SparkSession, sf: str) -> DataFrame:
    """A search answer per page: its links as results, asked for by its language."""
    pages = wh.table(spark, sf, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    items = F.transform(
        hrefs, lambda h: F.struct(F.when(~F.endswith(h, F.lit(".")), h).alias("link"), F.lit("t").alias("title"))
    )
    return pages.select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("request_id"),
        F.col("page_id").alias("query_no"),
        F.to_json(F.struct(items.alias("organic_results"))).alias("payload"),
    )


LINKS = """
found AS (
  SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS request_id, page_id AS query_no,
         regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
links AS (
  SELECT request_id, query_no, CAST(k AS INTEGER) AS rank, hrefs[k] AS link
  FROM found, range(1, 7) t(k) WHERE k <= len(hrefs) AND hrefs[k] <> '' AND NOT ends_with(hrefs[k], '.'))"""


@query(f"WITH {LINKS} SELECT request_id, query_no, rank, link FROM links")
def search_links(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.search_links(_page_results(spark, sf))


FIRST_SEEN = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id, link ORDER BY query_no, rank) AS n FROM links),
firsts AS (SELECT request_id, link, query_no, rank FROM numbered WHERE n = 1)"""


@query(f"WITH {LINKS}, {FIRST_SEEN} SELECT request_id, link, query_no, rank FROM firsts")
def first_seen_links(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_seen_links(payloads.search_links(_page_results(spark, sf)))


@query(f"""
WITH {LINKS}, {FIRST_SEEN}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY query_no, rank, link) AS n FROM firsts)
SELECT request_id, link, query_no, rank FROM placed WHERE n <= 8""")
def top_links_per_request(spark: SparkSession, sf: str) -> DataFrame:
    firsts = ranking.first_seen_links(payloads.search_links(_page_results(spark, sf)))
    return ranking.top_k(firsts, ["request_id"], ["query_no", "rank", "link"], 8)


@query("""
SELECT page_id, url FROM pages
WHERE contains(html, '</html>') AND NOT regexp_matches(url, '#top')""")
def page_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Truncated pages count as failed, anchors as plain text."""
    fetched = wh.table(spark, sf, "pages").withColumns(
        {
            "status": F.when(F.contains("html", F.lit("</html>")), 200).otherwise(206),
            "content_type": F.when(F.contains("url", F.lit("#top")), "text/plain").otherwise("text/html; charset=utf-8"),
        }
    )
    return payloads.page_filter(fetched).select("page_id", "url")


# The references that the pages hold, the ampersand last.
PAGE_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _entities_sql(text: str) -> str:
    for entity, shown in PAGE_ENTITIES:
        text = f"replace({text}, '{entity}', '{shown}')"
    return text


VISIBLE = _entities_sql(
    r"""regexp_replace(regexp_replace(html,
      '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', ' ', 'g'),
      '(?s)<[/!?a-zA-Z][^>]*>', ' ', 'g')"""
)


@query(rf"""
WITH shown AS (SELECT page_id, substring(trim(regexp_replace({VISIBLE}, '\s+', ' ', 'g')), 1, 5000) AS text FROM pages)
SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM shown""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    shown = payloads.page_text(wh.table(spark, sf, "pages").select("page_id", "html"))
    return shown.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _news_path(shown: str, links: int, fetched: str) -> str:
    return rf"""
WITH asked AS (
  SELECT p.page_id % 20 AS request_id, p.page_id AS query_no, CAST(k + 1 AS INTEGER) AS rank, q.url AS link
  FROM pages p, range(0, 8) t(k) JOIN pages q ON q.page_id = (p.page_id * 3 + k * 5) % (SELECT count(*) FROM pages)
  WHERE k < {links}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id, link ORDER BY query_no, rank) AS n FROM asked),
placed AS (
  SELECT request_id, link, row_number() OVER (PARTITION BY request_id ORDER BY query_no, rank, link) AS position
  FROM numbered WHERE n = 1),
shown AS (
  SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url
  HAVING contains(arg_min(html, page_id), '</html>') AND NOT contains(url, '#top')),
texts AS (SELECT url, {shown} AS text FROM shown),
found AS (
  SELECT request_id, count(*) AS n, string_agg(md5(text), ',' ORDER BY position) AS text_md5s
  FROM placed JOIN texts ON url = link WHERE {fetched} GROUP BY 1),
sources AS (SELECT request_id, string_agg(link, ' ' ORDER BY position) AS sources FROM placed WHERE position <= 10 GROUP BY 1)
SELECT request_id, sources, CAST(coalesce(n, 0) AS INTEGER) AS n_texts, coalesce(text_md5s, '') AS text_md5s
FROM sources LEFT JOIN found USING (request_id)"""


WHOLE_TEXT = rf"trim(regexp_replace({VISIBLE}, '\s+', ' ', 'g'))"


def _searched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Search answers that name other pages, eight to a query, and those pages as fetched."""
    pages = wh.table(spark, sf, "pages")
    total = pages.count()
    target = F.pmod(F.col("page_id") * 3 + F.col("k") * 5, F.lit(total))
    named = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumn("to", target)
    found = named.join(pages.select(F.col("page_id").alias("to"), "url"), "to")
    items = F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda x: F.struct(x["url"].alias("link")))
    answers_ = found.groupBy("page_id").agg(F.to_json(F.struct(items.alias("organic_results"))).alias("payload"))
    asked = answers_.select((F.col("page_id") % 20).alias("request_id"), F.col("page_id").alias("query_no"), "payload")
    fetched = pages.withColumns(
        {
            "status": F.when(F.contains("html", F.lit("</html>")), 200).otherwise(206),
            "content_type": F.when(F.contains("url", F.lit("#top")), "text/plain").otherwise("text/html; charset=utf-8"),
        }
    )
    return asked, fetched


def _path_rows(texts: DataFrame, sources: DataFrame) -> DataFrame:
    at = F.sort_array(F.collect_list(F.struct("position", F.md5("text").alias("m"))))
    held = texts.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("n"), at.alias("at"))
    return sources.join(held, "request_id", "left").select(
        "request_id", F.array_join("sources", " ").alias("sources"), F.coalesce("n", F.lit(0)).alias("n_texts"),
        F.coalesce(F.array_join(F.col("at.m"), ","), F.lit("")).alias("text_md5s"),
    )


@query(_news_path(f"substring({WHOLE_TEXT}, 1, 5000)", 6, "position <= 8"))
def news_text_path(spark: SparkSession, sf: str) -> DataFrame:
    """Links to first seen, to pages, to texts, with each request's first ten links."""
    asked, fetched = _searched(spark, sf)
    return _path_rows(*news_path.news_texts(payloads.search_links(asked), fetched))


@query(_news_path(WHOLE_TEXT, 8, "TRUE"))
def news_text_path_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every result, every page and whole texts."""
    asked, fetched = _searched(spark, sf)
    return _path_rows(*news_path.news_texts(payloads.search_links(asked, num=None), fetched, fetched=None, cap=None))


@query(r"""
WITH fenced AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 'fr' THEN ' ' || text || chr(9)
                 WHEN 'de' THEN '' ELSE text END AS t FROM documents),
bare AS (
  SELECT doc_id, CASE WHEN t = '' THEN '{}'
         ELSE regexp_replace(regexp_replace(t, '```json|```', '', 'g'), '^\s+|\s+$', '', 'g') END AS s FROM fenced)
SELECT doc_id, length(s) AS n_chars, md5(s) AS text_md5 FROM bare""")
def code_fences(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    fenced = (
        F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit(" "), text, F.lit("\t")))
        .when(F.col("lang") == "de", F.lit(""))
        .otherwise(text)
    )
    bare = wh.table(spark, sf, "documents").select("doc_id", strip_fences(fenced).alias("s"))
    return bare.select("doc_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("text_md5"))


@query("""
SELECT l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber || '/' || l_extendedprice AS request_id,
       k AS item, l_suppkey || 's' AS exporter, round(CASE k WHEN 1 THEN l_extendedprice ELSE l_quantity END, 2) AS trade_value_usd,
       strftime(l_shipdate, '%Y-%m') AS timestamp
FROM lineitem, range(1, 3) t(k)
WHERE CASE k WHEN 1 THEN l_returnflag <> 'A' ELSE l_linestatus = 'F' END""")
def trade_edges_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Two edges per order line; wrong types in some of them."""
    line = wh.table(spark, sf, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    exporter = F.concat(F.col("l_suppkey").cast("string"), F.lit("s"))
    first = F.struct(
        exporter.alias("exporter"),
        F.lit("1").alias("importer"),
        F.when(F.col("l_returnflag") == "A", F.lit("unknown")).otherwise(F.col("l_extendedprice").cast("string")).alias("trade_value_usd"),
        month.alias("timestamp"),
    )
    second = F.struct(
        exporter.alias("exporter"),
        F.when(F.col("l_linestatus") == "F", "2").alias("importer"),
        F.col("l_quantity").alias("trade_value_usd"),
        month.alias("timestamp"),
    )
    edges = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]"))
    key = F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    valid = payloads.edges_valid(line.select(key.alias("request_id"), edges.alias("edges")))
    return valid.select(
        "request_id",
        F.col("importer").cast("long").alias("item"),
        "exporter",
        F.round("trade_value_usd", 2).alias("trade_value_usd"),
        "timestamp",
    )


@query("""
SELECT c_custkey AS address,
       CASE WHEN c_acctbal <> 0 AND c_custkey <> 0 THEN c_acctbal END AS lat,
       CASE WHEN c_acctbal <> 0 AND c_custkey <> 0 THEN CAST(c_custkey AS DOUBLE) END AS lon
FROM customer""")
def geocode_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in every shape the geocoders use, by market segment."""
    long_names = F.to_json(F.struct(F.col("c_acctbal").alias("latitude"), F.col("c_custkey").alias("longitude")))
    short_names = F.to_json(F.struct(F.col("c_acctbal").alias("lat"), F.col("c_custkey").alias("lng")))

    def inside(name: str, body: Column) -> Column:
        return F.concat(F.lit('{"' + name + '":'), body, F.lit("}"))

    def listed(body: Column) -> Column:
        return F.concat(F.lit("["), body, F.lit("]"))

    segment = F.col("c_mktsegment")
    payload = (
        F.when(segment == "AUTOMOBILE", listed(long_names))
        .when(segment == "BUILDING", inside("copResults", short_names))
        .when(segment == "FURNITURE", inside("results", listed(short_names)))
        .when(segment == "HOUSEHOLD", inside("copResults", listed(long_names)))
        .otherwise(short_names)
    )
    rows = wh.table(spark, sf, "customer").select(F.col("c_custkey").alias("address"), payload.alias("payload"))
    return payloads.geocode_payload(rows)


@query(f"""
SELECT g.key, g.lat, g.lon, f.feature, f.weight, c.id AS city_id, count(*) AS n_suppliers
FROM supplier JOIN {values_sql(GAZETTEER, 'g(priority, key, lat, lon)')} ON g.priority = s_nationkey + 1
  JOIN {values_sql(CITIES, 'c(priority, id, name, x, y)')} ON c.priority = s_nationkey + 1
  JOIN (VALUES (0, 'global_risk', 0.05e0), (1, 'inventory_days', 0.2e0), (2, 'past_delay_days', 0.2e0), (3, 'news_vol_7d', 0.15e0),
               (4, 'neg_tone_frac_3d', 0.15e0), (5, 'strike_flag_7d', 0.15e0), (6, 'weather_anomaly_7d', 0.1e0))
       AS f(slot, feature, weight) ON f.slot = s_suppkey % 7
GROUP BY ALL""")
def dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers against the built-in dimensions by position."""
    d = dims(spark)
    supplier = wh.table(spark, sf, "supplier")
    return (
        supplier.join(F.broadcast(d["gazetteer"]), F.col("priority") == F.col("s_nationkey") + 1)
        .drop("priority")
        .join(F.broadcast(d["cities"].select("priority", F.col("id").alias("city_id"))), F.col("priority") == F.col("s_nationkey") + 1)
        .join(F.broadcast(d["features"].select("ordinal", "feature", "weight")), F.col("ordinal") % 7 == F.col("s_suppkey") % 7)
        .groupBy("key", "lat", "lon", "feature", "weight", "city_id")
        .agg(F.count(F.lit(1)).alias("n_suppliers"))
    )


@query("""
SELECT o_orderkey AS request_id,
       o_orderpriority || '|' || n_name || '|' || c_mktsegment || '|' || CASE WHEN o_orderstatus = 'F' THEN c_name ELSE '' END AS lane
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def lane_keys(spark: SparkSession, sf: str) -> DataFrame:
    customer = wh.table(spark, sf, "customer")
    nation = wh.table(spark, sf, "nation")
    rows = (
        wh.table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    seller = F.when(F.col("o_orderstatus") == "F", F.col("c_name"))
    return rows.select(
        F.col("o_orderkey").alias("request_id"),
        lane_key(F.col("o_orderpriority"), F.col("n_name"), F.col("c_mktsegment"), seller).alias("lane"),
    )


@query(
    "WITH req AS (SELECT c_custkey AS request_id, c_mktsegment AS component, n_name AS seller_loc, 'Port ' || c_nationkey AS import_loc,"
    " CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS seller FROM customer JOIN nation ON c_nationkey = n_nationkey), t AS ("
    "SELECT * FROM (VALUES "
    + ", ".join(f"({n}, '{t}')" for n, t in enumerate(SEARCH_TEMPLATES, 1))
    + ") AS x(template_no, template)) SELECT request_id, CAST(2 * template_no - 1 + s AS INTEGER) AS query_no, template_no,"
    " CASE s WHEN 0 THEN 'seller' ELSE 'import' END AS side, replace(replace(replace(template, '{component}', component), '{seller}', seller),"
    " '{loc}', CASE s WHEN 0 THEN seller_loc ELSE import_loc END) AS query FROM req, t, range(0, 2) r(s)"
)
def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    nation = wh.table(spark, sf, "nation")
    rows = wh.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = rows.select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_mktsegment").alias("component_type"),
        F.col("n_name").alias("seller_location"),
        F.concat(F.lit("Port "), F.col("c_nationkey").cast("string")).alias("import_location"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("seller_name"),
    )
    return mentions.search_queries(asked)


@query("""
SELECT o_orderstatus, count(*) AS n_rows, count(*) AS n_ids, count(*) FILTER (o_orderstatus <> 'P') AS n_given,
       count(*) FILTER (o_orderstatus = 'P') AS n_made
FROM orders GROUP BY 1""")
def request_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Ids are made only where none is given, and no two rows share one."""
    given = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string"))
    rows = with_identity(wh.table(spark, sf, "orders").select("o_orderstatus", given.alias("request_id")))
    made = (F.length("request_id") == 36) & F.col("created_at").isNotNull()
    return rows.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("request_id").alias("n_ids"),
        F.count_if(~made).alias("n_given"),
        F.count_if(made).alias("n_made"),
    )


@query("""
SELECT event_id AS request_id,
       CASE event_type WHEN 'view' THEN CAST(trunc(value) AS INTEGER) WHEN 'click' THEN CAST(trunc(value) AS INTEGER) ELSE 0 END AS news_vol_7d,
       CASE event_type WHEN 'view' THEN round(value / 500, 6) WHEN 'click' THEN 0.0 ELSE 0.0 END AS neg_tone_frac_3d,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN CASE WHEN value > 50 THEN 1 ELSE 0 END ELSE 0 END AS strike_flag_7d
FROM events""")
def news_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by event type: full and fenced, partial, text number, null, broken."""
    value = F.col("value").cast("string")
    share = (F.col("value") / 500).cast("string")
    text = (
        F.when(
            F.col("event_type") == "view",
            F.concat(F.lit('```json\n{"news_vol_7d":'), value, F.lit(',"neg_tone_frac_3d":'), share, F.lit(',"strike_flag_7d":"1"}\n```')),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit('{"news_vol_7d":'), value, F.lit(',"strike_flag_7d":'), (F.col("value") > 50).cast("string"), F.lit("}")),
        )
        .when(F.col("event_type") == "error", F.concat(F.lit('{"news_vol_7d":"'), value, F.lit('x","strike_flag_7d":1}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"strike_flag_7d":null,"news_vol_7d":'), value, F.lit("}")))
        .otherwise(F.concat(F.lit("["), value, F.lit("]")))
    )
    rows = wh.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), text.alias("answer"))
    return answers.feature_json(rows, "answer", answers.NEWS_ANSWER).select(
        "request_id", "news_vol_7d", r6("neg_tone_frac_3d").alias("neg_tone_frac_3d"), "strike_flag_7d"
    )


@query("""
SELECT event_id AS request_id,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 0 END AS sanction_flag,
       CASE event_type WHEN 'view' THEN round(value, 6) ELSE 0.3 END AS political_risk_score,
       CASE event_type WHEN 'view' THEN 'n' || event_id END AS notes,
       CASE event_type WHEN 'view' THEN round(value, 6) WHEN 'click' THEN 0.2 ELSE 0.2 END AS global_risk,
       CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m') ELSE '2024-02' END AS month
FROM events""")
def political_and_pressure_answers(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value").cast("string")
    note = F.concat(F.lit('"n'), F.col("event_id").cast("string"), F.lit('"'))
    view = F.col("event_type") == "view"
    political = (
        F.when(view, F.concat(F.lit('{"sanction_flag":1,"political_risk_score":'), value, F.lit(',"notes":'), note, F.lit("}")))
        .when(F.col("event_type") == "click", F.lit('{"notes":null}'))
        .when(F.col("event_type") == "error", F.lit('{"sanction_flag":1,"notes":7}'))
        .otherwise(F.lit("none"))
    )
    pressure = (
        F.when(view, F.concat(F.lit('{"global_risk":'), value, F.lit(',"timestamp":"'), F.date_format("ts", "yyyy-MM"), F.lit('"}')))
        .when(F.col("event_type") == "click", F.lit("{}"))
        .otherwise(F.lit('{"global_risk":"high","timestamp":"2020-01"}'))
    )
    rows = wh.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), political.alias("political"), pressure.alias("pressure")
    )
    decoded = answers.feature_json(rows, "political", answers.POLITICAL_ANSWER)
    decoded = answers.feature_json(decoded, "pressure", answers.pressure_answer("2024-02"))
    return decoded.select(
        "request_id", "sanction_flag", r6("political_risk_score").alias("political_risk_score"), "notes",
        r6("global_risk").alias("global_risk"), F.col("timestamp").alias("month"),
    )


@query("""
SELECT event_id AS request_id, event_type IN ('view', 'click') AS accepted, CAST(CASE WHEN event_type IN ('view', 'click') THEN 0 END AS INTEGER) AS n_edges
FROM events""")
def trade_answers_other_edges(spark: SparkSession, sf: str) -> DataFrame:
    """An object or a text as edges holds none; a number, a flag and null are errors."""
    other = (
        F.when(F.col("event_type") == "view", "{}")
        .when(F.col("event_type") == "click", '"none"')
        .when(F.col("event_type") == "purchase", "7")
        .when(F.col("event_type") == "error", "true")
        .otherwise("null")
    )
    text = F.concat(F.lit('{"edges":'), other, F.lit("}"))
    rows = wh.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), text.alias("answer"))
    accepted, rejected = answers.trade_json(rows, "answer")
    return accepted.select("request_id", F.lit(True).alias("accepted"), F.size("edges").alias("n_edges")).unionByName(
        rejected.select("request_id", F.lit(False).alias("accepted"), F.lit(None).cast("int").alias("n_edges"))
    )


@query("""
SELECT event_id AS request_id, event_type NOT IN ('error', 'signup') AS accepted,
       CASE event_type WHEN 'view' THEN round(value, 6) WHEN 'click' THEN 30.0 WHEN 'purchase' THEN 30.0 END AS inventory_days,
       CASE event_type WHEN 'view' THEN 5.0 WHEN 'click' THEN round(value, 6) WHEN 'purchase' THEN 5.0 END AS past_delay_days,
       CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 0 END AS INTEGER) AS n_edges
FROM events""")
def trade_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Bad numbers and null edge lists go to the reject side."""
    value = F.col("value").cast("string")
    edge = F.lit('{"exporter":"a","importer":"b","trade_value_usd":1,"timestamp":"2024-01"}')
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"inventory_days":'), value, F.lit(',"edges":['), edge, F.lit(',{"exporter":3}]}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"past_delay_days":"'), value, F.lit('"}')))
        .when(F.col("event_type") == "error", F.lit('{"inventory_days":"low"}'))
        .when(F.col("event_type") == "signup", F.lit('{"edges":null}'))
        .otherwise(F.lit("no answer"))
    )
    rows = wh.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), text.alias("answer"))
    accepted, rejected = answers.trade_json(rows, "answer")
    good = accepted.select(
        "request_id", F.lit(True).alias("accepted"), r6("inventory_days").alias("inventory_days"),
        r6("past_delay_days").alias("past_delay_days"), F.size("edges").alias("n_edges"),
    )
    missing = F.lit(None)
    bad = rejected.select(
        "request_id", F.lit(False).alias("accepted"), missing.cast("double").alias("inventory_days"),
        missing.cast("double").alias("past_delay_days"), missing.cast("int").alias("n_edges"),
    )
    return good.unionByName(bad)


# ---------------------------------------------------------------------------
# Mention match: every benchmark text asks for its words
# ---------------------------------------------------------------------------

QUESTIONS = r"""
words AS (
  SELECT item_id, list_sort(list_filter(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+')), lambda w: w <> '')) AS ws
  FROM benchmark),
longest AS (
  SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS n
  FROM (SELECT item_id, unnest(ws) AS w FROM words)),
asked AS (
  SELECT item_id, list(w) AS required, ['the', 'la', 'der'] AS any_of FROM longest GROUP BY 1),
docs AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS ws FROM documents)"""


@query(f"""
WITH {QUESTIONS}
SELECT item_id AS request_id, doc_id FROM asked, docs WHERE list_has_all(ws, required) AND list_has_any(ws, any_of)""")
def mention_match(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = wh.table(spark, sf, "benchmark")
    words = F.array_join(mentions.terms(F.col("text")), " ")
    asked = benchmark.select(
        F.col("item_id").alias("request_id"), F.concat(words, F.lit(" the OR la OR der")).alias("query")
    )
    found = mentions.mention_match(wh.table(spark, sf, "documents").select("doc_id", "text"), asked)
    return mentions.requests_of_matches(asked, found)


@query(f"""
WITH {QUESTIONS}, choices AS (SELECT item_id, list(w) AS any_of FROM longest GROUP BY 1)
SELECT item_id AS request_id, doc_id FROM choices, docs WHERE list_has_any(ws, any_of)""")
def mention_match_any(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of alternatives alone: all words of each benchmark text."""
    words = mentions.terms(F.col("text"))
    asked = wh.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), F.array_join(words, " OR ").alias("query"))
    found = mentions.mention_match(wh.table(spark, sf, "documents").select("doc_id", "text"), asked)
    return mentions.requests_of_matches(asked, found)


# ---------------------------------------------------------------------------
# Places
# ---------------------------------------------------------------------------


@query("""
WITH places AS (SELECT c_custkey, lower(trim('Port of ' || n_name || ' North')) AS addr FROM customer JOIN nation ON c_nationkey = n_nationkey),
hits AS (
  SELECT c_custkey, min(n_nationkey) AS n FROM places JOIN nation ON contains(addr, lower(n_name)) OR contains(lower(n_name), addr) GROUP BY 1)
SELECT c_custkey AS address, lower(n_name) AS place_key, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lon
FROM hits JOIN nation ON n = n_nationkey""")
def geocode_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Ports named after nations, whose names contain each other."""
    nation = wh.table(spark, sf, "nation")
    gazetteer = nation.select(
        F.col("n_nationkey").alias("priority"), F.lower("n_name").alias("key"),
        F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lon"),
    )
    rows = wh.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    addressed = rows.select("c_custkey", F.concat(F.lit("Port of "), "n_name", F.lit(" North")).alias("addr"))
    found = locate.geocode_lookup(addressed, "addr", gazetteer)
    return found.select(F.col("c_custkey").alias("address"), "place_key", "lat", "lon")


@query("""
WITH addresses AS (
  SELECT 'Dock of ' || c_name || ' east' AS address FROM customer
  UNION SELECT CAST(p_partkey AS VARCHAR) FROM part
  UNION SELECT n_name FROM nation),
keys AS (SELECT c_custkey AS priority, lower(c_name) AS key, c_acctbal AS lat FROM customer),
hits AS (
  SELECT address, min(priority) AS n FROM addresses JOIN keys
    ON contains(lower(address), key) OR contains(key, lower(address)) GROUP BY 1)
SELECT a.address, k.key AS place_key, k.lat FROM addresses a LEFT JOIN hits h USING (address) LEFT JOIN keys k ON k.priority = h.n""")
def geocode_long_gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """A gazetteer as long as the customer table, matched in both directions."""
    customer = wh.table(spark, sf, "customer")
    gazetteer = customer.select(
        F.col("c_custkey").alias("priority"), F.lower("c_name").alias("key"), F.col("c_acctbal").alias("lat"), F.lit(0.0).alias("lon")
    )
    addresses = (
        customer.select(F.concat(F.lit("Dock of "), "c_name", F.lit(" east")).alias("address"))
        .union(wh.table(spark, sf, "part").select(F.col("p_partkey").cast("string")))
        .union(wh.table(spark, sf, "nation").select("n_name"))
        .distinct()
    )
    return locate.geocode_lookup(addresses, "address", gazetteer).select("address", "place_key", "lat")


PLACE_NAMES = values_sql([(name,) for _, name, _, _ in CITIES], "p(priority, name)")
GAZETTEER_SQL = values_sql(GAZETTEER, "g(priority, key, lat, lon)")


def _place_of(nation: str) -> Column:
    """A city name for each nation key, taken from the city list."""
    names = F.split(F.lit("|".join(name for _, name, _, _ in CITIES)), r"\|")
    return F.try_element_at(names, (F.col(nation) + 1).cast("int"))


@query(f"""
WITH places AS (SELECT n_nationkey, n_regionkey, p.name || ', ' || n_name AS addr FROM nation JOIN {PLACE_NAMES} ON p.priority = n_nationkey + 1),
known AS (
  SELECT addr, min(priority) AS n FROM places JOIN {GAZETTEER_SQL} ON contains(lower(addr), key) OR contains(key, lower(addr)) GROUP BY 1),
resolved AS (
  SELECT n_nationkey, p.addr,
         CASE n_regionkey WHEN 0 THEN n_nationkey + 0.25 WHEN 1 THEN n_nationkey + 0.5 ELSE g.lat END AS lat,
         CASE n_regionkey WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE g.lon END AS lon
  FROM places p LEFT JOIN known k USING (addr) LEFT JOIN {GAZETTEER_SQL} ON g.priority = k.n)
SELECT c_custkey, addr, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM customer JOIN resolved ON c_nationkey = n_nationkey""")
def geocode_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Provider 1 knows region 0, provider 2 regions 0 and 1, the gazetteer the rest."""
    nation = wh.table(spark, sf, "nation").withColumn("address", F.concat(_place_of("n_nationkey"), F.lit(", "), "n_name"))
    p1 = nation.where("n_regionkey = 0").select("address", (F.col("n_nationkey") + 0.25).alias("lat"), F.lit(1.0).alias("lon"))
    p2 = nation.where("n_regionkey in (0, 1)").select("address", (F.col("n_nationkey") + 0.5).alias("lat"), F.lit(2.0).alias("lon"))
    rows = wh.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    addressed = rows.select("c_custkey", F.col("address").alias("addr"))
    return locate.geocode_resolve(addressed, "addr", p1, p2).select("c_custkey", "addr", "lat", "lon")


def _lane_places(spark: SparkSession, sf: str) -> DataFrame:
    """Seller and import location of every order line, as free text."""
    return wh.trade_lines(spark, sf).select(
        F.concat(_place_of("seller_nation"), F.lit(", "), "seller_name").alias("seller_location"),
        F.concat(F.lit("Port of "), _place_of("import_nation")).alias("import_location"),
    )


LANE_PLACES = f"""
lanes AS (
  SELECT sp.name || ', ' || sn.n_name AS seller_location, 'Port of ' || cp.name AS import_location
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN customer ON o_custkey = c_custkey
    JOIN {PLACE_NAMES.replace('p(', 'sp(')} ON sp.priority = s_nationkey + 1
    JOIN {PLACE_NAMES.replace('p(', 'cp(')} ON cp.priority = c_nationkey + 1)"""


@query(f"""
WITH {LANE_PLACES}, texts AS (SELECT seller_location AS t FROM lanes UNION SELECT import_location FROM lanes),
hits AS (SELECT t, min(priority) AS n FROM texts JOIN {GAZETTEER_SQL} ON contains(lower(t), key) OR contains(key, lower(t)) GROUP BY 1),
found AS (SELECT t, lat, lon FROM hits JOIN {GAZETTEER_SQL} ON priority = n)
SELECT s.lat AS seller_lat, s.lon AS seller_lon, i.lat AS import_lat, i.lon AS import_lon, count(*) AS n_lines
FROM lanes LEFT JOIN found s ON s.t = seller_location LEFT JOIN found i ON i.t = import_location GROUP BY 1, 2, 3, 4""")
def resolve_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = locate.resolve_pair(_lane_places(spark, sf))
    return pairs.groupBy("seller_lat", "seller_lon", "import_lat", "import_lon").agg(F.count(F.lit(1)).alias("n_lines"))


CITY_SQL = values_sql([(id_, name) for id_, name, _, _ in CITIES], "c(priority, id, name)")
COUNTRY_SQL = values_sql(COUNTRY_CITY, "k(priority, key, id)")


def _city_of_sql(source: str, text: str, key: str) -> str:
    return f"""
  SELECT x.{key}, coalesce(arg_min(h.id, h.place), '') AS city_id
  FROM {source} x LEFT JOIN (
    SELECT s.{key}, c.id, c.priority AS place FROM {source} s JOIN {CITY_SQL}
      ON s.{text} <> '' AND (contains(lower(s.{text}), lower(c.name)) OR contains(lower(c.name), lower(s.{text})))
    UNION ALL
    SELECT s.{key}, k.id, 1000 + k.priority FROM {source} s JOIN {COUNTRY_SQL} ON contains(lower(s.{text}), k.key)) h USING ({key})
  GROUP BY x.{key}"""


COUNTRY_NAMES = [key for key, _ in COUNTRY_CITY]


@query(f"""
WITH texts AS (
  SELECT c_custkey, CASE c_mktsegment
    WHEN 'AUTOMOBILE' THEN p.name || ', ' || k.key
    WHEN 'BUILDING' THEN ' ' || upper(k.key) || ' '
    WHEN 'FURNITURE' THEN substring(p.name, 1, 3)
    WHEN 'HOUSEHOLD' THEN 'Greater ' || k.key || ' area'
    ELSE c_name END AS loc
  FROM customer JOIN {PLACE_NAMES} ON p.priority = c_nationkey + 1 JOIN {COUNTRY_SQL} ON k.priority = c_custkey % 26 + 1),
matched AS ({_city_of_sql('texts', 'loc', 'c_custkey')})
SELECT c_custkey, loc, city_id FROM texts JOIN matched USING (c_custkey)""")
def city_match(spark: SparkSession, sf: str) -> DataFrame:
    countries = F.array(*[F.lit(k) for k in COUNTRY_NAMES])
    country = F.element_at(countries, (F.col("c_custkey") % 26 + 1).cast("int"))
    place = _place_of("c_nationkey")
    segment = F.col("c_mktsegment")
    loc = (
        F.when(segment == "AUTOMOBILE", F.concat(place, F.lit(", "), country))
        .when(segment == "BUILDING", F.concat(F.lit(" "), F.upper(country), F.lit(" ")))
        .when(segment == "FURNITURE", F.substring(place, 1, 3))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("Greater "), country, F.lit(" area")))
        .otherwise(F.col("c_name"))
    )
    rows = wh.table(spark, sf, "customer").select("c_custkey", loc.alias("loc"))
    return locate.city_match(rows, "loc")


@query("""
WITH texts AS (SELECT c_custkey, 'Port of ' || c_name || CASE WHEN c_nationkey % 2 = 0 THEN ' North' ELSE '' END AS loc FROM customer),
hits AS (
  SELECT t.c_custkey, min(c.c_custkey) AS n FROM texts t JOIN customer c ON contains(lower(t.loc), lower(c.c_name)) GROUP BY 1),
lands AS (SELECT t.c_custkey, min(n_nationkey) AS n FROM texts t JOIN nation ON contains(lower(t.loc), lower(n_name)) GROUP BY 1)
SELECT t.c_custkey, coalesce('c' || CASE WHEN h.n % 3 > 0 THEN h.n END, 'n' || l.n, '') AS city_id
FROM texts t LEFT JOIN hits h USING (c_custkey) LEFT JOIN lands l USING (c_custkey)""")
def city_match_long(spark: SparkSession, sf: str) -> DataFrame:
    """A city list of as many rows as there are customers, a third of them without a name."""
    customer = wh.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))
    cities = customer.select(
        F.col("c_custkey").cast("int").alias("priority"), F.concat(F.lit("c"), "c_custkey").alias("id"), name.alias("name")
    )
    lands = wh.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("int").alias("priority"), F.lower("n_name").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("city_id")
    )
    north = F.when(F.col("c_nationkey") % 2 == 0, " North").otherwise("")
    rows = customer.select("c_custkey", F.concat(F.lit("Port of "), "c_name", north).alias("loc"))
    return locate.city_match(rows, "loc", cities=cities, country_city=lands).select("c_custkey", "city_id")


# ---------------------------------------------------------------------------
# Routes
# ---------------------------------------------------------------------------

NATION_EDGES = """
edges AS (
  SELECT sn.n_name AS src, cn.n_name AS dst, CAST(count(*) % 20 AS INTEGER) AS hardship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  WHERE sn.n_nationkey <> cn.n_nationkey GROUP BY 1, 2)"""
UNDIRECTED = """
und AS (SELECT src, dst, min(hardship) AS hardship FROM
  (SELECT src, dst, hardship FROM edges UNION ALL SELECT dst, src, hardship FROM edges) GROUP BY 1, 2)"""
# best label (hardship, hops, path) per pair, grown one leg at a time
BEST = """
starts AS (SELECT DISTINCT src AS node FROM und),
grown AS (
  SELECT 0 AS k, node AS start, node AS "end", {'d': CAST(0 AS BIGINT), 'h': 0, 'p': [node]} AS label FROM starts
  UNION ALL
  SELECT k + 1, start, "end", min(label) FROM (
    SELECT k, start, "end", label FROM grown
    UNION ALL
    SELECT k, g.start, e.dst, {'d': CAST(g.label.d + e.hardship AS BIGINT), 'h': g.label.h + 1, 'p': list_append(g.label.p, e.dst)}
    FROM grown g JOIN und e ON e.src = g."end") WHERE k < 24 GROUP BY 1, 2, 3),
best AS (SELECT start, "end", label FROM grown WHERE k = 24),
traded AS (SELECT start, "end", label FROM best JOIN edges ON src = start AND dst = "end")"""


def _traded(edges: DataFrame) -> DataFrame:
    """The pairs of nations that trade with each other, as routes asked for."""
    return edges.select(F.col("src").alias("start"), F.col("dst").alias("end"))


@query(f"WITH {NATION_EDGES}, {UNDIRECTED} SELECT src, dst, hardship FROM und")
def undirected_edges(spark: SparkSession, sf: str) -> DataFrame:
    return routes.undirected_edges(wh.nation_edges(spark, sf))


@query(f'WITH RECURSIVE {NATION_EDGES}, {UNDIRECTED}, {BEST} SELECT start, "end", label.d AS hardship FROM traded')
def route_distances(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut_lineage(wh.nation_edges(spark, sf))
    return routes.route_distance(edges, _traded(edges))


@query("""
WITH RECURSIVE edges AS (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(min(l_quantity) AS INTEGER) AS hardship FROM lineitem GROUP BY 1, 2),
und AS (SELECT src, dst, hardship FROM edges UNION ALL SELECT dst, src, hardship FROM edges),
asked AS (SELECT DISTINCT 's' || s_suppkey AS start, 'p' || (s_suppkey * 7) AS "end" FROM supplier WHERE s_suppkey IS NOT NULL),
grown(start, "end", node, d) USING KEY (start, node) AS (
  SELECT start, "end", start, CAST(0 AS BIGINT) FROM asked
  UNION
  SELECT g.start, g."end", e.dst, min(g.d + e.hardship)
  FROM grown g JOIN und e ON e.src = g.node
    LEFT JOIN recurring.grown k ON k.start = g.start AND k.node = e.dst
    LEFT JOIN recurring.grown t ON t.start = g.start AND t.node = g."end"
  WHERE e.hardship IS NOT NULL AND (k.d IS NULL OR g.d + e.hardship < k.d) AND (t.d IS NULL OR g.d + e.hardship < t.d)
  GROUP BY 1, 2, 3)
SELECT a.start, a."end", g.d AS hardship FROM asked a LEFT JOIN grown g ON g.start = a.start AND g.node = a."end" """)
def route_distances_large(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts as one large graph; every supplier asks for a part."""
    edges = wh.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")
    ).agg(F.min("l_quantity").cast("int").alias("hardship"))
    asked = wh.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("start"), F.concat(F.lit("p"), F.col("s_suppkey") * 7).alias("end")
    )
    return routes.route_distance(cut_lineage(edges), asked)


@query(f"""
WITH RECURSIVE {NATION_EDGES}, {UNDIRECTED}, {BEST}
SELECT start, "end", array_to_string(label.p, '>') AS path, label.d AS hardship, label.h AS hops FROM traded""")
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut_lineage(wh.nation_edges(spark, sf))
    return routes.route_path(edges, _traded(edges)).withColumn("path", F.array_join("path", ">"))


LEGS = """
legs AS (
  SELECT start, "end", CAST(i AS INTEGER) AS leg_no, label.p[i] AS src, label.p[i + 1] AS dst
  FROM traded, range(1, 25) t(i) WHERE i < len(label.p))"""


@query(f"""
WITH RECURSIVE {NATION_EDGES}, {UNDIRECTED}, {BEST}, {LEGS}
SELECT start, "end", leg_no, src, dst, hardship FROM legs JOIN und USING (src, dst)""")
def route_legs(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut_lineage(wh.nation_edges(spark, sf))
    paths = routes.route_path(edges, _traded(edges))
    return routes.route_legs(edges, paths).select("start", "end", "leg_no", "src", "dst", "hardship")


@query(f"""
WITH RECURSIVE {NATION_EDGES}, {UNDIRECTED}, {BEST}, {LEGS},
used AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(*) AS n FROM legs GROUP BY 1, 2)
SELECT src, dst, hardship, coalesce(n, 0) AS n_routes, n IS NOT NULL AS on_route
FROM edges LEFT JOIN used ON lo = least(src, dst) AND hi = greatest(src, dst)""")
def route_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut_lineage(wh.nation_edges(spark, sf))
    return routes.route_edges(edges, routes.route_path(edges, _traded(edges)))


@query(f"""
WITH lines AS (
  SELECT l_suppkey, l_partkey, [sc.id, n_name, cc.id] AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN {CITY_SQL.replace('c(', 'sc(')} ON sc.priority = s_nationkey + 1
    JOIN {CITY_SQL.replace('c(', 'cc(')} ON cc.priority = c_nationkey + 1),
paths AS (SELECT path, count(*) AS n_lines FROM lines GROUP BY 1),
steps AS (SELECT path, n_lines, unnest(path) AS x, generate_subscripts(path, 1) AS i FROM paths)
SELECT string_agg(coalesce(c.name, x), ' → ' ORDER BY i) AS route, n_lines
FROM steps LEFT JOIN {CITY_SQL} ON c.id = x GROUP BY path, n_lines""")
def route_texts(spark: SparkSession, sf: str) -> DataFrame:
    """City ids become names; the nation in between is no city and stays as it is."""
    ids = F.split(F.lit("|".join(id_ for id_, *_ in CITIES)), r"\|")

    def city(nation: str) -> Column:
        return F.try_element_at(ids, (F.col(nation) + 1).cast("int"))

    lines = wh.trade_lines(spark, sf).select(
        F.array(city("seller_nation"), F.col("import_name"), city("import_nation")).alias("path")
    )
    paths = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    return routes.route_text(paths).select("route", "n_lines")


@query("""
SELECT o_orderkey, c.c_name || ' → ' || 'x' || o_orderstatus || ' → ' || coalesce(d.c_name, 'c' || (o_custkey * 7)) AS route
FROM orders JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer d ON d.c_custkey = o_custkey * 7""")
def route_texts_long(spark: SparkSession, sf: str) -> DataFrame:
    """Paths over a city list of as many rows as there are customers; some nodes are no city."""
    cities = wh.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    path = F.array(
        F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("x"), "o_orderstatus"), F.concat(F.lit("c"), F.col("o_custkey") * 7)
    )
    paths = wh.table(spark, sf, "orders").select("o_orderkey", path.alias("path"))
    return routes.route_text(paths, cities).select("o_orderkey", "route")


CITY_EDGES = f"edges AS (SELECT src, dst, hardship FROM {values_sql(GRAPH_EDGES, 'e(n, src, dst, hardship)')})"


@query(f"""
WITH RECURSIVE {LANE_PLACES}, {CITY_EDGES}, {UNDIRECTED}, {BEST},
sides AS (SELECT DISTINCT seller_location AS t FROM lanes UNION SELECT DISTINCT import_location FROM lanes),
placed AS ({_city_of_sql('sides', 't', 't')}),
matched AS (
  SELECT seller_location, import_location, s.city_id AS start, i.city_id AS "end", count(*) AS n_lines
  FROM lanes JOIN placed s ON s.t = seller_location JOIN placed i ON i.t = import_location GROUP BY 1, 2, 3, 4)
SELECT seller_location, import_location, m.start, m."end", n_lines, b.label.d AS hardship, (
    SELECT string_agg(coalesce(c.name, n.x), ' → ' ORDER BY n.i)
    FROM (SELECT unnest(b.label.p) AS x, generate_subscripts(b.label.p, 1) AS i) n LEFT JOIN {CITY_SQL} ON c.id = n.x) AS route
FROM matched m LEFT JOIN best b ON b.start = m.start AND b."end" = m."end" AND m.start <> m."end" """)
def lane_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line routed over the city graph, counted per lane."""
    lanes = _lane_places(spark, sf).groupBy("seller_location", "import_location").agg(F.count(F.lit(1)).alias("n_lines"))
    found = routes.lane_routes(cut_lineage(lanes), dims(spark)["graph_edges"])
    return found.select("seller_location", "import_location", "start", "end", "n_lines", "hardship", "route")
