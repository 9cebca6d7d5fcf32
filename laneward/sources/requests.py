"""Request tables and nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = (
    "request_id string, created_at timestamp, component_type string, seller_location string, "
    "import_location string, seller_name string, additional_factors map<string,string>"
)
REQUIRED = ("component_type", "seller_location", "import_location")


def _complete() -> Column:
    present = [F.col(c).isNotNull() for c in REQUIRED]
    return present[0] & present[1] & present[2]


def requests_from(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a request without a required text is rejected."""
    filled = df.withColumn(
        "additional_factors", F.coalesce("additional_factors", F.expr("map()").cast("map<string,string>"))
    )
    return filled.where(_complete()), filled.where(~_complete())


RAW_LINE = "raw_line"


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request lines of JSON, each with why it is rejected: one frame, one scan.

    ``reason`` is null for a request to analyse, ``malformed`` for a line that is no
    JSON object, else ``missing`` and the required texts that it lacks. ``raw_line`` is
    the whole line wherever something in it could not be read as its column's type.
    """
    read = (
        spark.read.schema(f"{REQUEST_SCHEMA}, {RAW_LINE} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_LINE)
        .json(path)
    )
    return with_reason(read)


def with_reason(df: DataFrame) -> DataFrame:
    """Add ``reason`` to rows of the request schema and, if there is one, the raw line."""
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    names = [c.split()[0] for c in REQUEST_SCHEMA.split(", ")]
    unread = F.coalesce(*[F.col(c).cast("string") if c != "additional_factors" else F.to_json(c) for c in names]).isNull()
    line = F.col(RAW_LINE) if RAW_LINE in df.columns else F.lit(None).cast("string")
    reason = F.when(unread & line.isNotNull(), "malformed").when(~_complete(), F.concat(F.lit("missing "), missing))
    filled = F.coalesce("additional_factors", F.expr("map()").cast("map<string,string>"))
    return df.withColumn("reason", reason).withColumn("additional_factors", filled)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Rejected JSON lines keep their reason and their raw line."""
    if fmt != "json":
        return requests_from(spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path))
    rows = scan_requests(spark, path)
    return rows.where("reason IS NULL").drop("reason", RAW_LINE), rows.where("reason IS NOT NULL")


def report_rows(scored: DataFrame, mitigation: Column, features: list[str]) -> DataFrame:
    """One nested row per scored request (inputs, features, result, reports)."""
    inputs = [
        c
        for c in ("component_type", "seller_location", "import_location", "seller_name", "additional_factors")
        if c in scored.columns
    ]
    pairs = [x for f in features for x in (F.lit(f), F.col(f))]
    return scored.select(
        "request_id",
        "created_at",
        *([F.struct(*inputs).alias("inputs")] if inputs else []),
        F.create_map(*pairs).alias("features"),
        F.struct("risk_score", "risk_label", "risk_components").alias("result"),
        F.col("factors").alias("concise"),
        F.struct(
            F.col("factors").alias("risk_distribution"), mitigation.alias("mitigation_strategies")
        ).alias("comprehensive"),
    )


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    reports.write.format(fmt).mode(mode).save(path)
