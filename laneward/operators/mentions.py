"""Search-query fan-out and matching of queries against documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.dims import SEARCH_TEMPLATES
from laneward.operators.joins import is_small, lookup_join
from laneward.session import cut_lineage, shuffle_width

HOT_TERM = 100_000
#: Pairs of a query and a document that one task tells apart; fewer, but not fewer than FEW_PAIRS, if tasks would stand idle.
TASK_PAIRS, FEW_PAIRS = 2_000_000, 100_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def search_queries(requests: DataFrame) -> DataFrame:
    """(request_id, query_no, template_no, side, query): templates by locations."""

    def filled(template: str, location: str) -> Column:
        text = F.lit(template)
        for slot, value in (
            ("{component}", F.col("component_type")),
            ("{seller}", F.coalesce("seller_name", F.lit(""))),
            ("{loc}", F.col(location)),
        ):
            text = F.replace(text, F.lit(slot), value)
        return text

    rows = []
    for number, template in enumerate(SEARCH_TEMPLATES, start=1):
        for side in ("seller", "import"):
            rows.append(
                F.struct(
                    F.lit(len(rows) + 1).alias("query_no"),
                    F.lit(number).alias("template_no"),
                    F.lit(side).alias("side"),
                    filled(template, f"{side}_location").alias("query"),
                )
            )
    return requests.select("request_id", F.inline(F.array(*rows)))


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


ALTERNATIVES = r"\S+(?: OR \S+)+"


def query_terms(query: Column) -> tuple[Column, Column]:
    """(required words, words of which one is enough) of a query text."""
    alternatives = F.regexp_extract(query, f"({ALTERNATIVES})", 1)
    return (
        terms(F.regexp_replace(query, ALTERNATIVES, " ")),
        terms(F.regexp_replace(alternatives, " OR ", " ")),
    )


def mention_match(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc_id): documents with all required words and any alternative.

    docs: doc_id, text. queries: query; equal queries are matched once.

    Each query is looked up by one word only, the rarest of its required words
    (or by each alternative if it has none), so a frequent word costs nothing
    unless a query has no better one. Candidates are then checked in full.

    The words of a document are brought together once, in tasks whose number
    follows the candidates. Few lookups are broadcast to them, so the pairs of a
    document arise in one task and are never shuffled. Many lookups meet the words
    by a shuffle join; words found in more than HOT_TERM documents are split by
    document.
    """
    required, any_of = query_terms(F.col("query"))
    # long queries are carried as numbers and named again at the end
    named = cut_lineage(queries.select("query").distinct().withColumn("number", F.monotonically_increasing_id()))
    wanted = named.select(F.col("number").alias("query"), required.alias("required"), any_of.alias("any_of"))
    no_required = F.size("required") == 0
    lookups = wanted.select(
        "query",
        "required",
        "any_of",
        no_required.alias("by_any"),
        F.explode(F.when(no_required, F.col("any_of")).otherwise(F.col("required"))).alias("term"),
    )
    # texts are read once; only words that some query asks for are kept
    asked = wanted.select(F.explode(F.array_union("required", "any_of")).alias("term")).distinct()
    words = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term"))
    small = is_small(asked)
    postings = cut_lineage(words.join(F.broadcast(asked) if small else asked, "term", "left_semi"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = lookups.join(frequency, "term", "left")

    rarest = (
        known.where("not by_any")
        .groupBy("query")
        .agg(
            F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"),
            F.min(F.coalesce("df", F.lit(0))).alias("df"),
        )
    )
    either = known.where("by_any").select("query", "term", F.coalesce("df", F.lit(0)).alias("df"))
    chosen = cut_lineage(rarest.unionByName(either).where("df > 0"))
    total = chosen.agg(F.sum("df")).first()[0] or 0
    parts = max(1, -(-total // TASK_PAIRS), min(shuffle_width(docs.sparkSession), -(-total // FEW_PAIRS)))
    holds = (F.size(F.array_except("required", "doc_terms")) == 0) & (
        (F.size("any_of") == 0) | F.arrays_overlap("any_of", "doc_terms")
    )
    if is_small(chosen):
        found = _found_in_place(postings, chosen, wanted, holds, parts)
    else:
        found = _found_by_term(postings, chosen, wanted, holds, parts)
    found = found.withColumnRenamed("query", "number")
    return found.join(F.broadcast(named) if is_small(named) else named, "number").select("query", "doc_id")


def _found_in_place(postings: DataFrame, chosen: DataFrame, wanted: DataFrame, holds: Column, parts: int) -> DataFrame:
    """(query, doc_id) of few lookups, broadcast to the words of each document."""
    strict = chosen.join(wanted.where(F.size("required") > 0), "query")
    free = chosen.join(wanted.where(F.size("required") == 0).select("query"), "query", "left_semi")
    by_doc = postings.repartition(parts, "doc_id")
    if strict.isEmpty():
        # a document with one of its alternatives answers a query that requires nothing; several may lead to it
        return by_doc.join(F.broadcast(free.select("term", "query")), "term").select("query", "doc_id").distinct()
    nothing = F.lit(None).cast("array<string>")
    asked = strict.select("term", "query", "required", "any_of").unionByName(
        free.select("term", "query", nothing.alias("required"), nothing.alias("any_of"))
    )
    present = by_doc.groupBy("doc_id").agg(F.collect_set("term").alias("doc_terms"))
    led = present.withColumn("term", F.explode("doc_terms")).join(F.broadcast(asked), "term")
    answers = F.col("required").isNull() | (F.col("doc_id").isNotNull() & holds)
    return led.where(answers).select("query", "doc_id").distinct()


def _found_by_term(postings: DataFrame, chosen: DataFrame, wanted: DataFrame, holds: Column, parts: int) -> DataFrame:
    """(query, doc_id) of many lookups, which meet the words of all documents by a shuffle."""
    copies = F.ceil(F.col("df") / HOT_TERM).cast("int")
    probes = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    split = chosen.select("term", copies.alias("copies")).distinct()
    placed = (
        lookup_join(postings, split, "term", F.col("doc_id"))
        .where("copies IS NOT NULL")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    )
    candidates = probes.join(placed.select("term", "salt", "doc_id"), ["term", "salt"]).select("query", "doc_id")
    free = wanted.where(F.size("required") == 0).select("query")
    # told apart after the shuffle alone: before it one task may hold the pairs of many frequent words
    answered = candidates.join(free, "query", "left_semi").repartition(parts, "query", "doc_id").distinct()
    strict = wanted.where(F.size("required") > 0)
    present = postings.groupBy("doc_id").agg(F.collect_set("term").alias("doc_terms"))
    checked = candidates.join(strict, "query").join(present, "doc_id").where(holds).select("query", "doc_id")
    return answered.unionByName(checked.repartition(parts, "query", "doc_id").distinct())


def requests_of_matches(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """(request_id, doc_id) of matches made once per query text."""
    asked = cut_lineage(queries.select("request_id", "query").distinct())
    # few queries leave the matches where they are, beside the others of their document
    asked = F.broadcast(asked) if is_small(asked) else asked
    return asked.join(matches, "query").select("request_id", "doc_id").distinct()
