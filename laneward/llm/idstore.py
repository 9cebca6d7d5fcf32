"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneward.llm.common import byte_column
from laneward.llm.wordbpe import default_vocabulary, encoder

#: Documents whose ids a task holds at a time.
_STEP_ROWS = 1000

STORED = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    stripe_bytes: int = 16 << 20,
    index_rows: int = 1000,
) -> None:
    """Encode all documents and write them in ascending doc_id order as ORC files.

    The texts are dealt by range of doc_id (one shuffle) and sorted in each
    part; each part is one file. Integers are run-length coded by ORC; each
    stripe holds minimum, maximum and a Bloom filter of doc_id for every
    index_rows rows, so a lookup skips stripes and row groups, and a scan reads
    stripes in parallel. Rows that repeat an id follow one another, in the order
    of a hash of their text. Null text: the end token alone. Null ids come first.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"),
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, start = encoder(vocabulary).encode_all, TaskContext.get().partitionId(), 0
        for batch in (b.slice(at, _STEP_ROWS) for b in batches for at in range(0, b.num_rows, _STEP_ROWS)):
            ids = [np.append(x, np.uint32(end_id)) for x in encode_all(list(byte_column(batch, "text")))]
            counts = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(counts)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, np.int32)),
                    batch.column("doc_id"),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat)),
                ],
                names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            start += int(ends[-1]) if len(ends) else 0

    (
        rows.repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(encoded, STORED)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (signed view of the integers).

    A filter on doc_id reaches the ORC reader. The first id of each part comes
    from one row for each part, read from two columns.
    """
    stored = spark.read.schema(STORED).orc(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    # one row of two numbers for each file written, so the ids need no shuffle
    return stored.join(F.broadcast(firsts), "part").select(
        "doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def id_digests(ids: DataFrame) -> DataFrame:
    """The rows of read_ids with a checksum of the ids in place of the ids."""
    import zlib

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.values.to_numpy().astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return ids.mapInArrow(digested, "doc_id long, start long, n_tokens long, ids_crc32 long")
