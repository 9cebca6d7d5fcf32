"""Joining a table of unique keys to rows of which one key may hold a large share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.session import cut_lineage

BROADCAST_ROWS = 100_000
HOT_ROWS = 5_000_000
NULL_PARTS = 1024


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def small_or_merged(df: DataFrame) -> DataFrame:
    """A checkpointed frame to join: broadcast if it is counted short, else never, whatever its size is taken for."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """Left join of ``table`` (one row per key) to ``rows``.

    A table that proves short is broadcast, so the rows stay where they are.
    Otherwise keys with more than HOT_ROWS rows are split into parts by a hash
    of ``spread_by``, with a copy of the key's table row for each part, and rows
    with a null key are spread likewise.
    """
    stored = cut_lineage(table)
    if is_small(stored):
        return rows.join(F.broadcast(stored), key, "left")
    copies = F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("_copies")
    counted = rows.groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key, copies)
    hot = cut_lineage(counted)
    # at most one hot key per HOT_ROWS rows
    hot = F.broadcast(hot) if is_small(hot) else hot
    parts = F.coalesce("_copies", F.lit(1))
    # rows without a key match nothing: they are dealt by their hash, not all to one task
    part = F.pmod(F.xxhash64(spread_by), F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(parts))
    spread = rows.join(hot, key, "left").withColumn("_part", part.cast("int"))
    copied = stored.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # counted as long, so it is not broadcast even if Spark takes it for short
    return spread.drop("_copies").join(copied.drop("_copies").hint("merge"), [key, "_part"], "left").drop("_part")
