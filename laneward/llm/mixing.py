"""Mixing documents to target shares by iterative proportional fitting of token weights."""

from __future__ import annotations

from collections.abc import Collection, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneward.llm.common import WORD, written

#: The values of a dimension that stay below their ceiling, pooled.
REST = "*"
#: Ceilings on the share of all tokens; what they cut goes to the other values.
CEILINGS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.2},
    "lang": {"en": 0.55},
    "topic": {"table": 0.05, "short": 0.25},
}
#: Ceilings of every value of a dimension that CEILINGS does not name, null among them.
EACH: dict[str, float] = {"source": 0.2, "lang": 0.55}
ROUNDS = 30
SEED = 11


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by form: table (a bar for every four words or more), short (under 300 words) or long."""
    bars = F.length(F.regexp_replace(text, r"[^|]+", ""))
    return F.when((n_tokens > 0) & (4 * bars >= n_tokens), "table").when(n_tokens < 300, "short").otherwise("long")


def _key(value: Column) -> Column:
    """A value as it is named in the raked table, apart from REST: "=" and the value, or "-" for null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _pool(key: Column, named: Collection[str]) -> Column:
    return F.when(key.isin(*named), key).otherwise(REST) if named else F.lit(REST)


def marginal(held: Mapping[str, float], ceilings: Mapping[str, float], full: Collection[str] = ()) -> dict[str, float]:
    """Target share of each value: the share it holds or its ceiling, the lesser; the pool takes the rest.

    The values in full take their ceiling whole.
    """
    total = sum(held.values())
    want = {v: ceilings[v] if v in full else min(m / total, ceilings[v]) for v, m in held.items() if v != REST}
    if REST in held:
        rest = 1 - sum(want.values())
        want[REST] = rest if rest > 1e-9 else held[REST] / total
    whole = sum(want.values())
    return {v: w / whole for v, w in want.items()}


def rake(
    cells: Mapping[tuple[str, ...], float], targets: list[Mapping[str, float]], rounds: int = ROUNDS
) -> dict[tuple[str, ...], float]:
    """Weight of each cell, so that weighted masses meet the target shares of each dimension."""
    keys = sorted(cells)
    start = np.array([cells[k] for k in keys], float)
    mass = start.copy()
    for _ in range(rounds):
        for d, shares in enumerate(targets):
            values = list(shares)
            at = np.array([values.index(k[d]) for k in keys], int)
            held = np.bincount(at, mass, len(values))
            want = np.array([shares[v] for v in values])
            mass = mass * np.divide(want, held, out=np.zeros_like(want), where=held > 0)[at]
    return dict(zip(keys, (mass / start).tolist()))


def _cell_weights(
    sums: DataFrame, ceilings: Mapping[str, Mapping[str, float]], each: Mapping[str, float], rounds: int
) -> tuple[dict[str, list[str]], dict[tuple[str, ...], float]]:
    """Values named in each dimension, and the weight of each combination of them and the pools.

    Values above the ceiling of each value of their dimension, in the tokens kept, are
    named and take that ceiling whole, until there are none. The named ones hold a
    ceiling each, so there are about 1 / ceiling of them at most.
    """
    dims = list(ceilings)
    most = {d: {f"={v}": c for v, c in ceilings[d].items()} for d in dims}
    full: dict[str, set[str]] = {d: set() for d in dims}
    while True:
        pooled = [_pool(F.col(d), most[d]).alias(f"_{d}") for d in dims]
        rows = sums.groupBy(*pooled).agg(F.sum("n").alias("n")).collect()
        cells = {tuple(r[f"_{d}"] for d in dims): float(r["n"]) for r in rows}
        targets = []
        for k, d in enumerate(dims):
            held: dict[str, float] = {}
            for key, n in cells.items():
                held[key[k]] = held.get(key[k], 0.0) + n
            targets.append(marginal(held, most[d], full[d]))
        weights = rake(cells, targets, rounds)
        whole = sum(cells[k] * w for k, w in weights.items())
        table = _weight_table(sums.sparkSession, dims, weights, "w")
        weighted = sums.select(*dims, "n", *pooled).join(F.broadcast(table), [f"_{d}" for d in dims])
        found = {
            d: [
                r["v"]
                for r in weighted.where(F.col(f"_{d}") == REST)
                .groupBy(F.col(d).alias("v"))
                .agg(F.sum(F.col("n") * F.col("w")).alias("n"))
                .where(F.col("n") > F.lit(1.001 * ceiling * whole))
                .collect()
            ]
            for d, ceiling in each.items()
            if cells and d in dims
        }
        for d, values in found.items():
            most[d].update(dict.fromkeys(values, each[d]))
            full[d].update(values)
        if not any(found.values()):
            return {d: list(most[d]) for d in dims}, weights


def _weight_table(spark: SparkSession, dims: list[str], weights: Mapping[tuple[str, ...], float], name: str) -> DataFrame:
    fields = ", ".join(f"`_{d}` string" for d in dims) + f", {name} double"
    return spark.createDataFrame([(*k, w) for k, w in weights.items()], fields)


def mixed_rows(
    docs: DataFrame,
    ceilings: Mapping[str, Mapping[str, float]] = CEILINGS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    each: Mapping[str, float] = EACH,
) -> DataFrame:
    """row (a struct of all columns of docs), topic, n_tokens, probability and kept, for every row.

    Tokens (words) are added up by source, language and topic. ceilings holds the
    ceilings of single values, each that of every other value of a dimension; values
    that stay below it are pooled. Target marginals are the shares held, cut to the
    ceilings; raking turns the sums into weights, and a document's probability is
    its cell's weight by the largest, so the expected tokens kept have the target
    shares and as many stay as one pass over the data allows. Kept is decided by a
    hash of the id, the same in every run. Where a dimension has too few values for
    its ceiling, they get equal parts of what the others leave.

    The sums by all values are written to the shared folder. Only sums of named
    values leave the cluster: at most one for each combination of values with a
    ceiling of their own and of those above the ceiling of each. A hot source is one
    partial sum for each task.

    Null source or language: a value like the others. Null or empty text: no tokens,
    probability 0. A null id is sampled by its text. Repeated rows share their fate.
    Very long texts count whole; an empty table gives no rows.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("n_tokens", F.regexp_count(text, F.lit(WORD)).cast("long"))
    rows = rows.withColumn("topic", topic(text, F.col("n_tokens")))
    values = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": F.col("topic")}
    dims = list(ceilings)
    sums = rows.where("n_tokens > 0").groupBy(*(_key(values[d]).alias(d) for d in dims)).agg(F.sum("n_tokens").alias("n"))
    named, weights = _cell_weights(written(sums, "mixing-sums"), ceilings, each, rounds)
    names = [f"_{d}" for d in dims]
    rows = rows.select("row", "n_tokens", "topic", *(_pool(_key(values[d]), named[d]).alias(f"_{d}") for d in dims))
    top = max(weights.values(), default=0.0) or 1.0
    table = _weight_table(docs.sparkSession, dims, {k: w / top for k, w in weights.items()}, "probability")
    drawn_by = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(text.cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn_by)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(table), names, "left").select(
        "row", "topic", "n_tokens", p.alias("probability"), (draw < p).alias("kept")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document; see mixed_rows()."""
    return mixed_rows(docs, **options).select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "probability", "kept")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, unchanged, that the mixture keeps."""
    return mixed_rows(docs, **options).where("kept").select("row.*")
