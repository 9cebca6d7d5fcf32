"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.llm.common import byte_column
from laneward.llm.wordbpe import default_vocabulary, encoder

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)
#: A cut made only to fill a gap gives a piece of at least so many tokens.
LEAST_CUT = 64


class CapacityTree:
    """Room left in up to n bins; first(size) is the leftmost bin with room for size."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        at, room = 1, self.room
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        at, room = bin_ + self.leaves, self.room
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into sizes, each of 1 to capacity."""
    tree, bins = CapacityTree(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        tree.take(at, sizes[i])
    return bins


def plan(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of every document once.

    Full stretches of long documents are sequences of their own; the rests go
    first-fit decreasing; then the emptiest sequences are cut up to fill gaps.
    """
    full = [[(d, at, capacity)] for d, n in enumerate(lengths) for at in range(0, n - capacity + 1, capacity)]
    rests = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    packed = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    packed.sort(key=lambda b: -sum(p[2] for p in b))
    rooms = [capacity - sum(p[2] for p in b) for b in packed]
    usable = [r if r >= LEAST_CUT else 0 for r in rooms]
    gaps, at = sum(usable), 0
    while len(packed) > 1 and capacity - rooms[-1] <= gaps - usable[-1]:
        gaps -= usable.pop()
        rooms.pop()
        for doc, start, length in packed.pop():
            while length:
                while usable[at] == 0:
                    at += 1
                part = min(length, usable[at])
                packed[at].append((doc, start, part))
                start, length = start + part, length - part
                usable[at] -= part
                rooms[at] -= part
                gaps -= part
    return full + packed


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = 4096,
    end_id: int = 2,
    group_docs: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    One row for each piece: doc_id, start (tokens of its document before it),
    length, doc_tokens (with the end token), sequence_id, offset (in the
    sequence, gapless from 0) and ids (little-endian unsigned 32-bit integers).
    Documents are dealt by a hash of their row number into groups of about
    group_docs, whatever their ids and texts are; each is packed alone, so the only
    shuffle moves each text once and a task holds one group. Rows are numbered in
    the order of id and text within their input partition, so that a task that runs
    again deals them the same way. Tokens are made after the shuffle, once.

    Null or empty text: one token, the end. Very long texts: full sequences
    and a rest. Rows that repeat an id are packed each. A null id is kept as
    null. Empty table: no rows. Columns other than doc_id and text are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"),
    ).sortWithinPartitions("doc_id", "tie")
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    dealt = rows.select("doc_id", "text", F.pmod(row, F.lit(groups)).alias("group"))

    def packed(table: pa.Table) -> pa.Table:
        encode_all = encoder(vocabulary).encode_all
        group = table.column("group")[0].as_py()
        doc_ids, ids = [], []
        for batch in table.to_batches():
            doc_ids += batch.column("doc_id").to_pylist()
            ids += [np.append(x, np.uint32(end_id)) for x in encode_all(list(byte_column(batch, "text")))]
        rows = [
            (doc, start, length, (group << 32) + k, offset)
            for k, sequence in enumerate(plan([len(x) for x in ids], capacity))
            for (doc, start, length), offset in zip(sequence, _offsets(sequence))
        ]
        doc, start, length, sequence, offset = zip(*rows)
        return pa.table(
            {
                "doc_id": pa.array([doc_ids[d] for d in doc], pa.int64()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "doc_tokens": pa.array([len(ids[d]) for d in doc], pa.int64()),
                "sequence_id": pa.array(sequence, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
                "ids": pa.array([ids[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length)], pa.binary()),
            }
        )

    return dealt.groupBy("group").applyInArrow(packed, PIECES)


def _offsets(sequence: list[tuple[int, int, int]]) -> Iterator[int]:
    at = 0
    for _, _, length in sequence:
        yield at
        at += length
