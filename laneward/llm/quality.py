"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.llm.common import BLANK, WORD, let

#: Frequent function words of the languages of the corpus.
STOP_WORDS = tuple(
    "the of and to a in is that it for on with as are this be by from or an at was "
    "der die das und ist von mit für den ein eine nicht auf des sich dem zu "
    "le la les de du des et est un une que pour dans qui en sur par pas au avec "
    "el los las y que en un una por con para es del se su no al lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= top / bottom <= most; a missing bound is open.

    top and bottom name measures. With a bottom of 0 the ratio is 0.
    """

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None


#: The threshold table of the production filter, beyond the two base rules.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.1),
    Rule("stop words", "n_stop_words", "n_words", 0.06, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("upper-case letters", "n_upper", "word_chars", None, 0.4),
)


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_upper"
).split()


def _count(text: Column, others: str) -> Column:
    """Characters of the text that are left without those that the pattern `others` matches."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeated(keys: Column) -> Column:
    """Indices of sorted keys that are equal to a neighbour."""
    return F.filter(
        F.sequence(F.lit(0), F.size(keys) - 1),
        lambda i: (keys[i] == F.get(keys, i + 1)) | (keys[i] == F.get(keys, i - 1)),
    )


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that the array holds twice or more.

    Most texts repeat no window, which distinct hashes prove. Else windows are
    sorted as hashes with their position in the low bits, and those that meet an
    equal hash are compared as text. Linear in the array but for the sorts.
    """

    none = F.array().cast("array<int>")

    def exact(w: Column, hashes: Column, bits: Column) -> Column:
        """Positions of repeated windows; bits holds the low bits' number and mask, computed once."""
        packed = F.transform(
            hashes, lambda h, i: F.call_function("shiftleft", h, bits["n"]).bitwiseOR(i.cast("long"))
        )
        maybe = let(
            F.sort_array(packed),
            lambda s: let(
                F.transform(s, lambda x: F.call_function("shiftright", x, bits["n"])),
                lambda keys: F.transform(_repeated(keys), lambda i: s[i].bitwiseAND(bits["mask"]).cast("int")),
            ),
        )
        texts = F.transform(
            F.filter(maybe, lambda i: i <= F.size(w) - size),
            lambda i: F.struct(F.concat_ws(" ", *(w[i + k] for k in range(size))).alias("g"), i.alias("i")),
        )
        return let(
            F.sort_array(texts),
            lambda s: let(
                s["g"],
                lambda g: F.when(F.size(g) > 0, F.transform(_repeated(g), lambda i: s[i]["i"])).otherwise(none),
            ),
        )

    def counted(w: Column) -> Column:
        last = F.size(w) - size
        n_bits = F.length(F.bin(F.size(w).cast("long"))).cast("int")
        bits = let(
            n_bits,
            lambda n: F.struct(n.alias("n"), (F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1).alias("mask")),
        )
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, size))))
        places = let(
            hashes,
            lambda h: F.when(
                F.size(F.array_distinct(h)) < F.size(h), F.sort_array(let(bits, lambda b: exact(w, h, b)))
            ).otherwise(none),
        )
        covered = let(
            places,
            lambda p: F.when(
                F.size(p) > 0,
                F.aggregate(
                    F.sequence(F.lit(0), F.size(p) - 1),
                    F.lit(0).cast("long"),
                    lambda total, i: total
                    + F.when(i + 1 < F.size(p), F.least(F.lit(size), p[F.least(i + 1, F.size(p) - 1)] - p[i])).otherwise(size),
                ),
            ).otherwise(F.lit(0).cast("long")),
        )
        return F.when(last > 0, covered).otherwise(F.lit(0).cast("long"))

    return let(words, counted)


def measures(text: Column) -> Column:
    """All counts of a text as one struct; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
        plain = F.split(F.lower(t), r"[^\p{L}]+")
        return F.struct(
            let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")
                ),
            ).alias("l"),
            F.size(F.filter(plain, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("stop"),
            _count(t, rf"{BLANK}+").alias("chars"),
            _count(t, r"[^#*$%&|<>]+").alias("symbols"),
            _count(t, r"[^\p{Lu}]+").alias("upper"),
        )

    return let(
        let(whole, of),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            m["chars"].alias("word_chars"),
            m["symbols"].alias("n_symbols"),
            m["l"]["d"].alias("n_dup_lines"),
            m["w"]["r"].alias("n_repeat_words"),
            m["l"]["n"].alias("n_lines"),
            m["stop"].alias("n_stop_words"),
            m["upper"].alias("n_upper"),
        ),
    )


def passes(rule: Rule, m: Column) -> Column:
    bottom = m[rule.bottom]
    ratio = F.when(bottom > 0, m[rule.top] / bottom).otherwise(F.lit(0.0))
    bounds = []
    if rule.least is not None:
        bounds.append(ratio >= rule.least)
    if rule.most is not None:
        bounds.append(ratio <= rule.most)
    return reduce(Column.__and__, bounds, F.lit(True))


def base_failed(m: Column) -> Column:
    """Under 50 words, or more than half of the words in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judged(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """One struct for a text: the measures, base_failed, failed (names of broken rules) and kept."""
    none = F.array().cast("array<string>")

    def verdict(m: Column) -> Column:
        broken = [F.when(~passes(r, m), F.lit(r.name)) for r in rules]
        failed = F.filter(F.array(*broken), lambda name: name.isNotNull()) if broken else none
        return F.struct(
            *(m[name].alias(name) for name in MEASURES),
            base_failed(m).alias("base_failed"),
            failed.alias("failed"),
            (~base_failed(m) & (F.size(failed) == 0)).alias("kept"),
        )

    return let(measures(text), verdict)


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measures of its whole text, base_failed, failed and kept, for every row.

    One projection without shuffle or user functions. Null and empty text: all
    counts 0, base_failed. Very long texts are measured whole. Repeated rows are
    judged each. Null ids stay. An empty table gives no rows. Columns other than
    doc_id and text are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), rules).alias("m")).select(
        "doc_id", "m.*"
    )


def good_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs, unchanged, that quality() keeps; in the scan, without a join."""
    return docs.where(judged(F.col("text"), rules)["kept"])
