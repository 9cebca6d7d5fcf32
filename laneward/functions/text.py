"""Text rules on columns: lane keys, code fences, visible page text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# All named character references of HTML, as Python's library lists them.
ENTITIES = {name.rstrip(";"): shown for name, shown in html5.items() if name.endswith(";")}

PAGE_TEXT_CAP = 5000

# comments, scripts, styles and templates, each up to its end mark or the end of the page
HIDDEN_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<template\b[^>]*>.*?(?:</template\s*>|\z)"
)


def lane_key(component: Column, seller_loc: Column, import_loc: Column, seller: Column) -> Column:
    return F.concat_ws("|", component, seller_loc, import_loc, F.coalesce(seller, F.lit("")))


def strip_fences(text: Column) -> Column:
    """Text without code fences and outer whitespace; empty becomes ``{}``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "```json|```", "")
    bare = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("{}")).otherwise(bare)


def _references(text: Column) -> Column:
    """Character references decoded in one pass: what one yields is not decoded again."""
    mark = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        # a piece is what follows an ampersand
        name = F.regexp_extract(piece, "^" + mark[1:], 1)
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        code = F.when(digits != "", code).cast("long")
        shown = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, shown).otherwise(F.lit("�"))
        found = F.when(digits != "", number).otherwise(F.try_element_at(named, name))
        rest = F.substr(piece, F.length(name) + 2)
        return F.when((name != "") & found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(tail, ""))).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text nodes of a page joined by single spaces, without script or style."""
    text = F.regexp_replace(html, HIDDEN_MARKUP, " ")
    text = F.regexp_replace(text, r"(?s)<[/!?a-zA-Z][^>]*>", " ")
    text = _references(text)
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(text)


def page_text_column(html: Column, cap: int | None = PAGE_TEXT_CAP) -> Column:
    """Visible text cut to ``cap`` characters; None cuts nothing."""
    return visible_text(html) if cap is None else F.substring(visible_text(html), 1, cap)
