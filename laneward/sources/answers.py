"""Feature answers that arrive as JSON text, decoded leniently."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.functions.text import strip_fences
from laneward.functions.variant import field, is_kind, is_missing, parsed, with_variant
from laneward.sources.payloads import valid_edges


@dataclass(frozen=True)
class AnswerField:
    """A field of an answer: its type, and its value when it is missing.

    ``optional`` fields may be null and must be texts otherwise.
    """

    name: str
    type: str
    default: object
    optional: bool = False


NEWS_ANSWER = [
    AnswerField("news_vol_7d", "int", 0),
    AnswerField("neg_tone_frac_3d", "double", 0.0),
    AnswerField("strike_flag_7d", "int", 0),
]
POLITICAL_ANSWER = [
    AnswerField("sanction_flag", "int", 0),
    AnswerField("political_risk_score", "double", 0.3),
    AnswerField("notes", "string", None, optional=True),
]
TRADE_ANSWER = [
    AnswerField("inventory_days", "double", 30.0),
    AnswerField("past_delay_days", "double", 5.0),
]


def pressure_answer(month: str) -> list[AnswerField]:
    """``month`` ('YYYY-MM') stands in where an answer names none."""
    return [
        AnswerField("global_risk", "double", 0.2),
        AnswerField("timestamp", "string", month, optional=True),
    ]


def _decoded(value: Column, spec: AnswerField) -> Column:
    """The field's value; null where it is present but does not fit."""
    path = f"$.{spec.name}"
    found = field(value, path, spec.type)
    if spec.optional:
        found = F.when(is_kind(field(value, path), "STRING"), found)
    default = F.lit(spec.default).cast(spec.type)
    return F.when(is_missing(value, path), default).otherwise(found)


def _failed(value: Column, spec: AnswerField) -> Column:
    """Present but null, or of a type that does not convert."""
    path = f"$.{spec.name}"
    present = ~is_missing(value, path)
    if spec.optional:
        return present & ~is_kind(field(value, path), "STRING") & ~is_kind(field(value, path), "VOID")
    return present & field(value, path, spec.type).isNull()


def feature_json(df: DataFrame, text: str, spec: Sequence[AnswerField]) -> DataFrame:
    """Add the fields of an answer text.

    A missing field takes its own default. Text that is no JSON object, or one
    field that does not convert, gives the whole record its defaults.
    """
    value = F.col("_v")
    bad = value.isNull() | ~is_kind(value, "OBJECT")
    for item in spec:
        bad = bad | _failed(value, item)
    bad = F.coalesce(bad, F.lit(True))
    fields = {
        s.name: F.when(F.col("_bad"), F.lit(s.default).cast(s.type)).otherwise(_decoded(value, s))
        for s in spec
    }
    return (
        with_variant(df, parsed(strip_fences(F.col(text))), "_v")
        .withColumn("_bad", bad)
        .withColumns(fields)
        .drop("_v", "_bad")
    )


def trade_json(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) trade answers.

    Text that does not parse means an empty answer (all defaults, no edges);
    an answer that parses but has a bad number or a null or scalar ``edges`` is
    rejected; an object or text as ``edges`` holds none.
    """
    value = F.col("_v")
    given = F.coalesce(parsed(strip_fences(F.col(text))), F.parse_json(F.lit("{}")))
    edges = field(value, "$.edges", "array<variant>")
    # an object or a text in place of the list holds no usable edge; null and scalars are errors
    other = is_kind(field(value, "$.edges"), "OBJECT") | is_kind(field(value, "$.edges"), "STRING")
    none_listed = edges.isNull() & ~F.coalesce(other, F.lit(False))
    bad = ~is_kind(value, "OBJECT") | (~is_missing(value, "$.edges") & none_listed)
    for item in TRADE_ANSWER:
        bad = bad | _failed(value, item)
    no_edges = F.expr(
        "cast(array() as array<struct<exporter:string,importer:string,trade_value_usd:double,timestamp:string>>)"
    )
    read = with_variant(df, given, "_v").withColumn("_bad", F.coalesce(bad, F.lit(True)))
    accepted = (
        read.where(~F.col("_bad"))
        .withColumns({s.name: _decoded(value, s) for s in TRADE_ANSWER})
        .withColumn("edges", F.coalesce(valid_edges(edges), no_edges))
        .drop("_v", "_bad")
    )
    return accepted, read.where("_bad").drop("_v", "_bad")
