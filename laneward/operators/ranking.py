"""Top-k and first-seen rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows of each group.

    Spark limits each group inside the map tasks already, so a hot group sends
    at most k rows per task through the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")


def first_seen_links(links: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Each link once per request, at its earliest (query_no, rank) position."""
    return (
        links.groupBy(id_col, "link")
        .agg(F.min(F.struct("query_no", "rank")).alias("_at"))
        .select(id_col, "link", "_at.query_no", "_at.rank")
    )


def link_positions(first_seen: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Number the kept links of a request in the order they were seen."""
    window = Window.partitionBy(id_col).orderBy("query_no", "rank", "link")
    return first_seen.withColumn("position", F.row_number().over(window))
