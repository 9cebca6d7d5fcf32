"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneward.session import shared_folder

#: One white space character, and what is between white space: the words of all operators.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Fixed odd multipliers of the word and shingle hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path not used before, in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write the frame to the shared folder once and read on from there.

    Cuts lineage like checkpoint(), in a columnar format, so that later reads
    prune columns. The files survive the loss of executors.
    """
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number, 0, 1, 2, ..., in the order of some columns, nulls first.

    Rows are dealt by range (one shuffle) and written once; a key that holds many
    rows is split by the later columns and, between equal rows, by the place of
    the row in its input. What is broadcast is one row for each task.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_place", 33)  # the task's number; the lower 33 bits count its rows
    held = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(firsts), "_part")
        .withColumn(name, F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_place", "_first")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() parts at exactly BLANK. None for null."""
    return [] if text is None else text.split()


def byte_column(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """A text column as UTF-8, one value at a time."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py()


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from its values end to end and the length of each list."""
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX_2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive words, by doubling; empty if there is none."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    done, done_len, power, power_len = None, 0, hashes, 1
    factor = _STEP  # _STEP ** power_len
    while True:
        if size & power_len:
            if done is None:
                done, done_len = power, power_len
            else:
                n = len(hashes) - done_len - power_len + 1
                done, done_len = done[:n] * factor + power[done_len : done_len + n], done_len + power_len
        if power_len * 2 > size:
            return mixed(done[: len(hashes) - size + 1])
        n = len(hashes) - 2 * power_len + 1
        power = power[:n] * factor + power[power_len : power_len + n]
        power_len *= 2
        with np.errstate(over="ignore"):
            factor = factor * factor


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class IdFilter:
    """A Bloom-like filter of ids with a fixed size, to thin out a scan before an exact join.

    It never misses an id. Past some millions of ids more and more others pass
    too, which costs time and never changes a result; its size stays bounded.
    """

    BITS = 1 << 23

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, ids: DataFrame, name: str) -> IdFilter:
        at = F.pmod(F.xxhash64(F.col(name)), F.lit(cls.BITS))
        rows = (
            ids.select(at.alias("at"))
            .groupBy((F.col("at") / 64).cast("int").alias("slot"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        )
        words = np.zeros(cls.BITS // 64, np.int64)
        table = rows.toArrow()  # at most BITS / 64 rows
        words[table.column("slot").to_numpy()] = table.column("bits").to_numpy()
        return cls(words)

    def _marked(self, df: DataFrame, name: str) -> DataFrame:
        used = np.flatnonzero(self.words)
        slots = df.sparkSession.createDataFrame(
            pa.table({"_slot": pa.array(used.astype(np.int32)), "_bits": pa.array(self.words[used])})
        )
        at = F.pmod(F.xxhash64(F.col(name)), F.lit(self.BITS))
        hit = F.coalesce(F.expr("(_bits & shiftleft(1L, cast(_at % 64 as int))) != 0"), F.lit(False))
        return (
            df.withColumn("_at", at)
            .join(F.broadcast(slots), (F.col("_at") / 64).cast("int") == F.col("_slot"), "left")
            .withColumn("_may", hit)
            .drop("_at", "_slot", "_bits")
        )

    def passing(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df whose id may be among the ids."""
        return self._marked(df, name).where("_may").drop("_may")

    def parted(self, df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose id may be among the ids, and the rows whose id is not."""
        marked = self._marked(df, name)
        return marked.where("_may").drop("_may"), marked.where("NOT _may").drop("_may")
