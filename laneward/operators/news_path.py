"""From search links to page texts: one plan for all requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.functions.text import PAGE_TEXT_CAP
from laneward.operators.ranking import first_seen_links, link_positions
from laneward.sources.payloads import page_filter, page_text

FETCHED = 8
SHOWN = 10


def fetched_pages(pages: DataFrame) -> DataFrame:
    """One row per url: of several fetches the one with the least page_id."""
    first = F.min_by(F.struct("status", "content_type", "html"), "page_id")
    return pages.groupBy("url").agg(first.alias("_p")).select("url", "_p.*")


def news_texts(
    links: DataFrame,
    pages: DataFrame,
    fetched: int | None = FETCHED,
    shown: int | None = SHOWN,
    cap: int | None = PAGE_TEXT_CAP,
) -> tuple[DataFrame, DataFrame]:
    """(texts, sources) of requests.

    links: request_id, query_no, rank, link. pages: page_id, url, status,
    content_type, html. A request's links count once, where first seen. texts is
    (request_id, position, link, text) for its first ``fetched`` links whose page
    answered with HTML; sources is (request_id, sources), its first ``shown`` links
    in order. None lifts a bound. Links are cut before they meet the pages, so
    the join carries at most ``fetched`` rows per request.
    """
    placed = link_positions(first_seen_links(links))
    wanted = placed if fetched is None else placed.where(F.col("position") <= fetched)
    known = page_filter(fetched_pages(pages)).withColumnRenamed("url", "link")
    texts = page_text(wanted.join(known, "link"), cap=cap).select("request_id", "position", "link", "text")
    listed = placed if shown is None else placed.where(F.col("position") <= shown)
    at = F.sort_array(F.collect_list(F.struct("position", "link")))
    sources = listed.groupBy("request_id").agg(at.alias("_s")).select("request_id", F.col("_s.link").alias("sources"))
    return texts, sources

