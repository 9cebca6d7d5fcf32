"""Built-in dimensions, each replaceable by a user table of the same schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values. Results depend on the values and on their order.
# ---------------------------------------------------------------------------

# feature, weight, default when absent, impact text
FEATURES = [
    ("inventory_days", 0.20, 30.0, "Inventory coverage may be tightening"),
    ("past_delay_days", 0.20, 5.0, "Historical delays suggest risk carryover"),
    ("news_vol_7d", 0.15, 0.0, "High volume of disruption mentions"),
    ("neg_tone_frac_3d", 0.15, 0.0, "Negative news sentiment trending"),
    ("strike_flag_7d", 0.15, 0.0, "Labor unrest may affect ports/logistics"),
    ("weather_anomaly_7d", 0.10, 0.0, "Recent weather anomaly near route/plant"),
    ("global_risk", 0.05, 0.2, "Global chain pressure elevated"),
]

DEFAULT_IMPACT = "Contributing risk factor"

MITIGATION = {
    "Weather Risk Mitigation": "Plan alternate routes and maintain buffer inventory during severe weather.",
    "Labor Strike Contingency": "Pre-negotiate slots with alternative ports and carriers.",
    "Sanctions Compliance": "Continuously monitor regulations; pre-qualify alternate suppliers.",
}

# search templates: components of the query text, in order
SEARCH_TEMPLATES = [
    "{component} {seller} {loc} strike OR protest OR stoppage",
    "{component} {seller} {loc} delay OR disruption OR outage",
    "{component} {seller} {loc} supply chain bottleneck",
    "{component} {loc} semiconductor fab shutdown OR maintenance",
    "{seller} {loc} port congestion OR customs backlog",
]

# key, latitude, longitude
GAZETTEER = [
    ("hsinchu", 24.8138, 120.9675),
    ("taiwan", 25.0330, 121.5654),
    ("los angeles", 34.0522, -118.2437),
    ("new york", 40.7128, -74.0060),
    ("houston", 29.7604, -95.3698),
    ("san francisco", 37.7749, -122.4194),
    ("london", 51.5074, -0.1278),
    ("berlin", 52.5200, 13.4050),
    ("paris", 48.8566, 2.3522),
    ("rotterdam", 51.9244, 4.4777),
    ("hamburg", 53.5511, 9.9937),
    ("frankfurt", 50.1109, 8.6821),
    ("mumbai", 19.0760, 72.8777),
    ("delhi", 28.6139, 77.2090),
    ("new delhi", 28.6139, 77.2090),
    ("bangalore", 12.9716, 77.5946),
    ("chennai", 13.0827, 80.2707),
    ("kolkata", 22.5726, 88.3639),
    ("shanghai", 31.2304, 121.4737),
    ("beijing", 39.9042, 116.4074),
    ("shenzhen", 22.5431, 114.0579),
    ("guangzhou", 23.1291, 113.2644),
    ("tokyo", 35.6762, 139.6503),
    ("osaka", 34.6937, 135.5023),
    ("busan", 35.1796, 129.0756),
    ("seoul", 37.5665, 126.9780),
    ("singapore", 1.3521, 103.8198),
    ("dubai", 25.2048, 55.2708),
    ("cairo", 30.0444, 31.2357),
    ("lagos", 6.5244, 3.3792),
    ("sao paulo", -23.5505, -46.6333),
    ("mexico city", 19.4326, -99.1332),
    ("sydney", -33.8688, 151.2093),
    ("melbourne", -37.8136, 144.9631),
    ("bangkok", 13.7563, 100.5018),
    ("jakarta", -6.2088, 106.8456),
    ("hong kong", 22.3193, 114.1694),
    ("durban", -29.8587, 31.0218),
    ("usa", 39.8283, -98.5795),
    ("china", 35.8617, 104.1954),
    ("india", 20.5937, 78.9629),
    ("germany", 51.1657, 10.4515),
    ("japan", 36.2048, 138.2529),
    ("uk", 55.3781, -3.4360),
    ("brazil", -14.2350, -51.9253),
    ("australia", -25.2744, 133.7751),
]

# id, name, x, y
CITIES = [
    ("NYC", "New York", 184.3, 98.0),
    ("LA", "Los Angeles", 107.4, 111.3),
    ("London", "London", 312.8, 76.6),
    ("Paris", "Paris", 317.1, 81.8),
    ("Berlin", "Berlin", 336.3, 74.5),
    ("Tokyo", "Tokyo", 556.0, 108.0),
    ("Shanghai", "Shanghai", 524.2, 116.9),
    ("Dubai", "Dubai", 409.2, 128.7),
    ("Mumbai", "Mumbai", 439.7, 141.1),
    ("Singapore", "Singapore", 493.5, 176.3),
    ("Sydney", "Sydney", 555.9, 246.4),
    ("Cairo", "Cairo", 367.3, 117.2),
    ("Lagos", "Lagos", 318.9, 150.0),
    ("SaoPaulo", "São Paulo", 246.9, 200.8),
    ("Mexico", "Mexico City", 140.6, 140.4),
    ("Rotterdam", "Rotterdam", 325.2, 72.8),
    ("Hamburg", "Hamburg", 339.9, 70.5),
    ("Antwerp", "Antwerp", 320.0, 75.2),
    ("Frankfurt", "Frankfurt", 332.5, 79.2),
    ("HongKong", "Hong Kong", 515.8, 150.2),
    ("Busan", "Busan", 546.7, 102.5),
    ("Bangkok", "Bangkok", 479.5, 145.3),
    ("Jakarta", "Jakarta", 490.5, 190.2),
    ("Durban", "Durban", 364.2, 210.0),
    ("Houston", "Houston", 155.5, 130.5),
]

# country key, city id
COUNTRY_CITY = [
    ("usa", "NYC"),
    ("america", "NYC"),
    ("united states", "NYC"),
    ("california", "LA"),
    ("china", "Shanghai"),
    ("japan", "Tokyo"),
    ("india", "Mumbai"),
    ("uk", "London"),
    ("united kingdom", "London"),
    ("england", "London"),
    ("france", "Paris"),
    ("germany", "Berlin"),
    ("uae", "Dubai"),
    ("united arab emirates", "Dubai"),
    ("australia", "Sydney"),
    ("brazil", "SaoPaulo"),
    ("egypt", "Cairo"),
    ("nigeria", "Lagos"),
    ("mexico", "Mexico"),
    ("netherlands", "Rotterdam"),
    ("south korea", "Busan"),
    ("korea", "Busan"),
    ("thailand", "Bangkok"),
    ("indonesia", "Jakarta"),
    ("south africa", "Durban"),
    ("texas", "Houston"),
]

# from, to, hardship
GRAPH_EDGES = [
    ("NYC", "London", 3),
    ("NYC", "LA", 4),
    ("NYC", "Mexico", 5),
    ("London", "Paris", 2),
    ("London", "Berlin", 3),
    ("Paris", "Berlin", 2),
    ("Berlin", "Dubai", 0),
    ("Dubai", "Mumbai", 3),
    ("Dubai", "Cairo", 2),
    ("Mumbai", "Singapore", 4),
    ("Singapore", "Tokyo", 4),
    ("Singapore", "Shanghai", 2),
    ("Tokyo", "Shanghai", 2),
    ("Shanghai", "Tokyo", 2),
    ("Sydney", "Singapore", 5),
    ("Cairo", "Lagos", 4),
    ("LA", "Mexico", 3),
    ("Mexico", "SaoPaulo", 6),
    ("London", "Cairo", 4),
    ("Paris", "Cairo", 3),
    ("Mumbai", "Dubai", 5),
    ("Singapore", "Sydney", 5),
    ("LA", "Tokyo", 7),
    ("NYC", "SaoPaulo", 8),
    ("Sydney", "SaoPaulo", 7),
    ("Sydney", "Lagos", 6),
    ("SaoPaulo", "Lagos", 5),
    ("Rotterdam", "London", 2),
    ("Rotterdam", "Antwerp", 1),
    ("Rotterdam", "Hamburg", 2),
    ("Hamburg", "Berlin", 2),
    ("Frankfurt", "Berlin", 2),
    ("Frankfurt", "Paris", 2),
    ("Antwerp", "Paris", 2),
    ("HongKong", "Shanghai", 2),
    ("HongKong", "Singapore", 3),
    ("HongKong", "Tokyo", 3),
    ("Busan", "Tokyo", 2),
    ("Busan", "Shanghai", 2),
    ("Bangkok", "Singapore", 2),
    ("Bangkok", "Jakarta", 3),
    ("Jakarta", "Singapore", 2),
    ("Durban", "Lagos", 5),
    ("Durban", "Cairo", 7),
    ("Houston", "NYC", 3),
    ("Houston", "Mexico", 2),
    ("Houston", "SaoPaulo", 7),
]

# dashboard route rows: name, score above which the label is High (None: the
# overall label), reliability points subtracted, duration, cost
ROUTE_OPTIONS = [
    ("Primary Route", None, 0, "12 days", "$2,450"),
    ("Alternative Route A", 0.5, 5, "15 days", "$2,180"),
    ("Alternative Route B", 0.3, 10, "10 days", "$3,200"),
]

# ---------------------------------------------------------------------------

WEIGHT_SCHEMA = "ordinal int, feature string, weight double, default_value double, impact string"
GAZETTEER_SCHEMA = "priority int, key string, lat double, lon double"
CITY_SCHEMA = "priority int, id string, name string, x double, y double"
COUNTRY_SCHEMA = "priority int, key string, city_id string"
EDGE_SCHEMA = "src string, dst string, hardship int"


def _numbered(rows: list[tuple]) -> list[tuple]:
    return [(n, *row) for n, row in enumerate(rows, start=1)]


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """All built-in dimensions as frames, with their order made explicit."""
    return {
        "features": spark.createDataFrame(_numbered(FEATURES), WEIGHT_SCHEMA),
        "gazetteer": spark.createDataFrame(_numbered(GAZETTEER), GAZETTEER_SCHEMA),
        "cities": spark.createDataFrame(_numbered(CITIES), CITY_SCHEMA),
        "country_city": spark.createDataFrame(_numbered(COUNTRY_CITY), COUNTRY_SCHEMA),
        "graph_edges": spark.createDataFrame(GRAPH_EDGES, EDGE_SCHEMA),
    }


DIMENSION_ROW_LIMIT = 512


def small_rows(df: DataFrame, limit: int = DIMENSION_ROW_LIMIT) -> list | None:
    """Rows of a dimension if it has at most ``limit`` of them, else None.

    The read stops after ``limit + 1`` rows, so a large table costs little
    and never reaches the driver whole.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
