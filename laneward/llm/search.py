"""Ranked lexical search: range-maximum tables over posting lists, best-first intervals of documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneward.llm.common import byte_column, lists, new_folder, written

#: What is no letter or digit of ASCII becomes a blank, A-Z become a-z; all other bytes of UTF-8 belong to terms.
_FOLD = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256)
)
#: Item texts of one pass over the documents; their terms go to every task.
BLOCK_BYTES = 4 << 20
#: Documents and postings of one shard, whose tables a task holds at a time.
SHARD_DOCS, SHARD_POSTINGS = 10_000, 1 << 21
#: Documents that are added to a shard at once.
_STEP_DOCS = 500
#: Documents of an interval that is scored whole instead of being split again.
LEAF_DOCS = 256
#: Parts in which the tasks' best are ranked before they meet item by item.
PARTS = 32
_NULL_ID = -(1 << 63)

RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII, lower-cased in A-Z; none for null."""
    return [] if text is None else text.translate(_FOLD).split()


def term_weight(n_docs: int, held: int) -> int:
    """Weight of a term that `held` of n_docs documents hold."""
    return floor(1000 * log((2 * n_docs + 2) / (2 * held + 1)))


class Shard:
    """Posting lists of some documents end to end, in document order, with a range-maximum table over each.

    Row j of the table names, for each place, the posting of the greatest impact
    among 2**j from there on; two overlapping rows answer any range within a list.
    Equal impacts are told apart by chance, so that splits of many equal documents
    fall near the middle.
    """

    def __init__(self, n_docs: int, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        terms, self.docs, self.impacts = terms[order], docs[order], impacts[order]
        self.n_docs, n = n_docs, len(order)
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        self.key = terms.astype(np.int64) * n_docs + self.docs
        longest = int(np.diff(self.first).max()) if n_terms else 0
        chance = np.random.default_rng(0).integers(0, 1 << 20, n)
        rank = (self.impacts << 20) | chance
        self.table = np.empty((max(1, longest.bit_length()), n), np.int32)
        self.table[0] = np.arange(n, dtype=np.int32)
        for j in range(1, len(self.table)):
            half = 1 << (j - 1)
            a = self.table[j - 1]
            self.table[j] = a
            b = a[half:]
            self.table[j, : n - half] = np.where(rank[b] > rank[a[: n - half]], b, a[: n - half])
        self.rank = rank

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of the greatest impact in each range [a, b) of postings; none is empty."""
        j = np.frexp((b - a).astype(np.float64))[1] - 1
        left, right = self.table[j, a], self.table[j, b - (1 << j)]
        return np.where(self.rank[right] > self.rank[left], right, left)

    def search(self, terms: np.ndarray, ids: list[int], best: list[tuple[int, int]], k: int) -> None:
        """Bring the k best (score, -id) in the heap `best` up to date with the documents of this shard.

        The interval with the greatest sum of its terms' maxima comes first. It is
        split at the document of its greatest impact, which is scored; small ones are
        scored whole. Nothing is left to find once that sum is below the k-th score.
        """
        waiting: list[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def wait(lo: int, hi: int, terms: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            some = a < b
            if not some.any():
                return
            terms, a, b = terms[some], a[some], b[some]
            tops = self.most(a, b)
            bound = int(self.impacts[tops].sum())
            if bound > 0 and (len(best) < k or bound >= best[0][0]):
                cut = int(self.docs[tops[np.argmax(self.rank[tops])]])
                heapq.heappush(waiting, (-bound, lo, hi, cut, terms, a, b))

        def offer(score: int, doc: int) -> None:
            found = (score, -ids[doc])
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)

        wait(0, self.n_docs, terms, self.first[terms], self.first[terms + 1])
        while waiting:
            bound, lo, hi, cut, terms, a, b = heapq.heappop(waiting)
            if len(best) == k and -bound < best[0][0]:
                break
            if hi - lo <= LEAF_DOCS:
                n = b - a
                at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
                scores = np.zeros(hi - lo, np.int64)
                np.add.at(scores, self.docs[at] - lo, self.impacts[at])
                for doc in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                    offer(int(scores[doc]), lo + doc)
                continue
            wanted = terms.astype(np.int64) * self.n_docs + cut
            at = np.searchsorted(self.key, wanted)
            at = np.clip(at, a, b)
            held = at < b
            held[held] = self.key[at[held]] == wanted[held]
            score = int(self.impacts[at[held]].sum())
            if score > 0:
                offer(score, cut)
            wait(lo, cut, terms, a, at)
            wait(cut + 1, hi, terms, at + held, b)


def _postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and of the numbered terms those it holds and how often."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            keep, n, sizes, terms, counts = [], [], [], [], []
            for text in byte_column(batch, "text"):
                words = terms_of(text)
                keep.append(bool(words))
                if words:
                    found = [t for w in words if (t := get(w)) is not None]
                    term, count = np.unique(np.array(found, np.int32), return_counts=True)
                    n.append(len(words))
                    sizes.append(len(term))
                    terms.append(term)
                    counts.append(count)
            sizes = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").filter(pa.array(keep, pa.bool_())),
                    pa.array(n, pa.int64()),
                    lists(np.concatenate(terms or [np.empty(0, np.int32)]), sizes),
                    lists(np.concatenate(counts or [np.empty(0, np.int64)]).astype(np.int64), sizes),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, counts array<long>")


def _ranked(postings: DataFrame, items: list[tuple[int, np.ndarray]], n_terms: int, k: int) -> DataFrame:
    """item (its number), rank, doc_id, score over written postings."""
    n_docs, length = postings.agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(n_terms, np.int64)
    seen = postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row for each term asked
    held[seen.column("term").to_numpy()] = seen.column("count").to_numpy()
    weights = np.array([term_weight(n_docs, int(d)) for d in held], np.int64)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, size, docs = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP_DOCS):
                part = batch.slice(at, _STEP_DOCS)
                more = len(part.column("terms").flatten())
                if waiting and (docs + part.num_rows > SHARD_DOCS or size + more > SHARD_POSTINGS):
                    yield pa.Table.from_batches(waiting)
                    waiting, size, docs = [], 0, 0
                waiting.append(part)
                size, docs = size + more, docs + part.num_rows
        if waiting:
            yield pa.Table.from_batches(waiting)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for table in shards(batches):
            table = table.combine_chunks()
            ids = [_NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()]
            n = table.column("n").to_numpy()
            terms, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            docs = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            m = 50 + (50 * n * n_docs) // length
            impacts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
            shard = Shard(len(ids), docs, term, impacts, n_terms)
            for (_, asked), heap in zip(items, best):
                shard.search(asked, ids, heap, k)
        rows = [(item, s, -d) for (item, _), heap in zip(items, best) for s, d in heap]
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([None if r[2] == _NULL_ID else r[2] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([part] * len(rows), pa.int32()),
            ],
            names=["item", "doc_id", "score", "part"],
        )

    found = postings.mapInArrow(searched, "item long, doc_id long, score long, part int")
    for keys in (["item", "part"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        text = (text or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, sorted(set(terms_of(text)))))
        size += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, equal scores by doc_id.

    Items are taken in blocks of BLOCK_BYTES of text, whose terms every task gets.
    For each block one pass over the whole texts writes what documents hold of
    these terms; the counts of documents and terms come from there. A second pass
    forms posting lists with their range-maximum tables in shards of SHARD_DOCS
    documents, where the rows lie, searches them for all items of the block, and
    keeps k documents for each item from shard to shard. No posting is shuffled;
    k rows for each item and task meet in two steps.

    Null or empty text of a document: it has no terms and is not counted. Null or
    empty text of an item, or none of its terms held: no rows. A null doc_id comes
    first among equal scores. Rows that repeat an id, of a document or of an item,
    count each. Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path, done = new_folder(spark, "ranked"), 0
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in _blocks(items):
        number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        asked = [(done + i, np.array([number[t] for t in terms], np.int64)) for i, (_, terms) in enumerate(block)]
        postings = written(_postings(docs, number), "postings")
        names = spark.createDataFrame(
            [(done + i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long"
        )
        ranked = _ranked(postings, asked, len(number), k)
        ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        done += len(block)
    return spark.read.schema(RESULT).parquet(path)
