"""Removal of word passages that an earlier document holds, by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneward.llm.common import IdFilter, byte_column, mixed, sliding_min, window_hashes, word_hashes, written

#: Words of the grams whose least hash places a window.
GRAM = 8
#: Segments that stream over one copy of a reference's automaton, and segments of a shard.
STREAM, SHARD = 2000, 20_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

KEY = ["doc_id", "tie"]


class SuffixAutomaton:
    """All runs of words of some passages; a walk over other words gives its matching statistics."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, words in enumerate(passages):
            for word in words:
                last = self._extend(word, last)
            last = self._extend(k, last)  # an integer equals no word and parts the passages

    def _extend(self, word, last: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p != -1:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(word) == q:
                    nexts[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        return new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal [start, end) of the words that are covered by matches of at least `least` words."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        found: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            if matched >= least:
                start = i + 1 - matched
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, i + 1))
        return found


class _Powers:
    """Powers of the base and of its inverse, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE_INVERSE, k, 1 << 64))])


_powers = _Powers()


def window_runs(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one least gram: anchor, hash of the words of the run, first and last start."""
    grams = window_hashes(hashes, min(GRAM, size))
    least = sliding_min(grams, size - min(GRAM, size) + 1)
    if not len(least):
        none = np.empty(0, np.int64)
        return none, none, none, none
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    last = np.append(first[1:] - 1, len(least) - 1)
    end = last + size
    _powers.reach(len(hashes) + 1)
    sums = np.append(np.uint64(0), np.cumsum(hashes * _powers.down[: len(hashes)]))
    words = mixed((sums[end] - sums[first]) * _powers.up[first] + (end - first).astype(np.uint64))
    return least[first].view(np.int64), words.view(np.int64), first, last


def _hashes(text: bytes | None) -> np.ndarray:
    return word_hashes([] if text is None else text.split())


def runs(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, seg, doc_id, tie, s, e): the window runs of each document."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [window_runs(_hashes(t), size) for t in byte_column(batch, "text")]
            counts = [len(p[0]) for p in parts]
            if not sum(counts):
                continue
            at = pa.array(np.repeat(np.arange(len(parts)), counts))
            anchor, seg, s, e = (np.concatenate([p[k] for p in parts]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(seg), batch.column("doc_id").take(at), batch.column("tie").take(at),
                    pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)),
                ],
                names=["anchor", "seg", "doc_id", "tie", "s", "e"],
            )

    return docs.mapInArrow(scanned, "anchor long, seg long, doc_id long, tie int, s int, e int")


def _windows(asked: DataFrame, size: int) -> DataFrame:
    """(h, doc_id, tie, pos): the windows that start within the ranges asked of a document."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(byte_column(batch, "text")):
                grams = window_hashes(_hashes(text), size)
                pos = np.unique(np.concatenate([np.arange(r["s"], r["e"] + 1) for r in batch.column("ranges")[i].as_py()]))
                pos = pos[pos < len(grams)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[pos].view(np.int64)),
                        pa.array(np.full(len(pos), batch.column("doc_id")[i].as_py(), np.int64)),
                        pa.array(np.full(len(pos), batch.column("tie")[i].as_py(), np.int32)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    names=["h", "doc_id", "tie", "pos"],
                )

    return asked.mapInArrow(scanned, "h long, doc_id long, tie int, pos int")


def _segments(asked: DataFrame, size: int) -> DataFrame:
    """(f_doc, f_tie, doc_id, tie, at, words): what each document sends to each of its references.

    Ranges of window starts that touch are one segment, so every window inside a
    segment was asked for.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(byte_column(batch, "text")):
                words = [] if text is None else text.split()
                doc, tie = batch.column("doc_id")[i].as_py(), batch.column("tie")[i].as_py()
                ranges = sorted((r["f_doc"], r["f_tie"], r["s"], r["e"]) for r in batch.column("ranges")[i].as_py())
                for (f_doc, f_tie), some in groupby(ranges, key=lambda r: r[:2]):
                    held: list[list[int]] = []
                    for _, _, s, e in some:
                        if held and s <= held[-1][1] + 1:
                            held[-1][1] = max(held[-1][1], e)
                        else:
                            held.append([s, e])
                    out += [(f_doc, f_tie, doc, tie, s, b" ".join(words[s : e + size])) for s, e in held]
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["f_doc", "f_tie", "doc_id", "tie", "at", "words"]
            )

    return asked.mapInArrow(scanned, "f_doc long, f_tie int, doc_id long, tie int, at int, words binary")


def _matched(size: int):
    """Streams the segments of a shard over the automata of its references."""

    def matched(table: pa.Table) -> pa.Table:
        rows = table.select(["f_doc", "f_tie", "chunk", "doc_id", "tie", "at", "words"]).to_pylist()
        unit = lambda r: (r["f_doc"], r["f_tie"], r["chunk"])
        out: list[tuple] = []
        for (f_doc, f_tie, _), some in groupby(sorted(rows, key=unit), key=unit):
            held = list(some)
            own = [r for r in held if (r["doc_id"], r["tie"]) == (f_doc, f_tie)]
            automaton = SuffixAutomaton([r["words"].split() for r in own])
            for r in held:
                if r["doc_id"] > f_doc:
                    spans = automaton.spans(r["words"].split(), size)
                    out += [(r["doc_id"], r["tie"], r["at"] + a, r["at"] + b) for a, b in spans]
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "tie", "s", "e"), columns, kinds)})

    return matched


def repeated_spans(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, tie, spans): spans of words [s, e) that windows of an earlier document cover.

    rows: doc_id, tie and text of documents with an id.
    """
    keyed = Window.partitionBy("anchor", "seg").orderBy("doc_id", "tie", "s")
    beside = Window.partitionBy("anchor").orderBy("seg", "doc_id", "tie", "s")
    shared = written(
        runs(rows, size)
        .withColumn("f", F.first(F.struct("doc_id", "tie", "s")).over(keyed))
        .withColumn("near", F.coalesce(F.lag("doc_id").over(beside), F.lead("doc_id").over(beside)))
        .where("near IS NOT NULL")
        .select("anchor", "seg", *KEY, "s", "e", F.col("f.doc_id").alias("f_doc"), F.col("f.tie").alias("f_tie"), F.col("f.s").alias("f_s")),
        "runs",
    )
    same = shared.where("doc_id > f_doc").select(*KEY, "s", "e", "f_doc", "f_tie", "f_s")

    # runs that begin or end differently around one anchor can still share windows
    firsts = shared.where("doc_id = f_doc")
    mixed_anchors = firsts.groupBy("anchor").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("lo < hi")
    ask = written(
        firsts.join(mixed_anchors, "anchor").groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "asked"
    )
    by_hash = Window.partitionBy("h").orderBy("doc_id", "tie", "pos")
    partly = (
        _windows(IdFilter.of(ask, "doc_id").passing(rows, "doc_id").join(ask, KEY), size)
        .withColumn("f", F.first(F.struct("doc_id", "tie", "pos")).over(by_hash))
        .where("doc_id > f.doc_id")
        .select(
            *KEY, F.col("pos").alias("s"), F.col("pos").alias("e"),
            F.col("f.doc_id").alias("f_doc"), F.col("f.tie").alias("f_tie"), F.col("f.pos").alias("f_s"),
        )
    )
    found = written(same.unionByName(partly), "matches")
    wanted = written(
        found.select(*KEY, F.struct("f_doc", "f_tie", "s", "e").alias("r"))
        .unionByName(
            found.select(
                F.col("f_doc").alias("doc_id"), F.col("f_tie").alias("tie"),
                F.struct("f_doc", "f_tie", F.col("f_s").alias("s"), (F.col("f_s") + F.col("e") - F.col("s")).alias("e")).alias("r"),
            )
        )
        .groupBy(*KEY)
        .agg(F.collect_set("r").alias("ranges")),
        "ranges",
    )
    segments = written(
        _segments(IdFilter.of(wanted, "doc_id").passing(rows, "doc_id").join(wanted, KEY), size), "segments"
    )
    chunks = segments.groupBy("f_doc", "f_tie").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("chunks"))
    own = (F.col("doc_id") == F.col("f_doc")) & (F.col("tie") == F.col("f_tie"))
    shards = max(1, -(-segments.count() // SHARD))
    return (
        segments.join(chunks, ["f_doc", "f_tie"])
        .withColumn(
            "chunk",
            F.explode(
                F.when(own, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(
                    F.array(F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
                )
            ),
        )
        .withColumn("shard", F.pmod(F.xxhash64("f_doc", "f_tie", "chunk"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_matched(size), "doc_id long, tie int, s int, e int")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    )


def _cut(rows: DataFrame) -> DataFrame:
    """rows: row (anything), text, spans. Gives row, n_words, n_removed and kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(byte_column(batch, "text"), batch.column("spans")):
                words = [] if text is None else text.split()
                keep = np.ones(len(words), bool)
                for span in spans.as_py() or ():
                    keep[span["s"] : span["e"]] = False
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep) if k) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["row", "n_words", "n_removed", "kept"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(cut, f"row {kind}, n_words long, n_removed long, kept string")


def _parted(docs: DataFrame, row, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, text, spans) of the documents that may have repeated spans, and of those that have none."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.hash(F.col("text").cast("string")).alias("tie"), row.alias("row"),
    )
    known = rows.select("doc_id", "tie", "text").where("doc_id IS NOT NULL")
    spans = written(repeated_spans(known, size), "spans")
    some, rest = IdFilter.of(spans, "doc_id").parted(rows, "doc_id")
    kind = spans.schema["spans"].dataType
    return (
        some.join(spans, KEY, "left").select("row", "text", "spans"),
        rest.select("row", "text", F.lit(None).cast(kind).alias("spans")),
    )


def without_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words left, joined by one space) of every document.

    A word goes if a window of `size` consecutive words covers it whose words also
    start in a document with a smaller doc_id; windows are those of the input.

    Windows are placed by their least gram hash, so equal windows meet without
    shuffling all windows; runs of windows with equal words match at once, others
    window by window. What matched names, for each document, the earliest
    document (its reference) and the passages in question. Passages of the
    references form shards; a shard's automata are sent to as many tasks as its
    hottest reference needs, and the documents' segments stream over them. Only
    spans that an automaton confirms are removed.

    Null text and texts without words: zeros and an empty text. Shorter texts than
    a window keep all. Null ids and rows of one id are never references of one
    another; a null id keeps all its words. Repeated rows are cut alike. Very long
    texts are taken whole; an empty table gives no rows; other columns are ignored.
    """
    some, rest = _parted(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), size)
    return _cut(some).unionByName(_cut(rest)).select("row.doc_id", "n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """The documents with their repeated spans cut out, by the rule of without_repeats().

    Rows without such spans come back unchanged. A cut text is the words left,
    joined by one space, with n_chars (if there is such a column) set to its
    length; documents of which nothing is left are dropped. All columns stay.
    """
    some, rest = _parted(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), size)
    gone = F.col("n_removed") > 0
    new = F.col("row").withField("text", F.when(gone, F.col("kept")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withField("n_chars", F.when(gone, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars")))
    cut = _cut(some).where((F.col("n_removed") < F.col("n_words")) | ~gone).select(new.alias("row"))
    return cut.unionByName(rest.select("row")).select("row.*")
