"""Language-model scores: marginal probability over all segmentations into an existing vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneward.llm.common import byte_column, mixed, written
from laneward.llm.pieces import START, default_pieces, pieces

#: A unit ends when it holds so many words or distinct words.
UNIT_WORDS, UNIT_DISTINCT = 4_000_000, 400_000
#: Words of one length that go through the lattice together.
LATTICE_WORDS = 20_000
#: Share of the prior in the piece probabilities.
PRIOR = 0.01

_LN10 = log(10)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf


class Lattice:
    """Forward and backward recursions in log space, over many words of one length at once."""

    def __init__(self, path: str):
        vocabulary = pieces(path)
        self.size, self.first_byte, self.longest = len(vocabulary.names), vocabulary.first_byte, vocabulary.longest
        self.prior = np.exp(vocabulary.logp)
        #: pieces that begin a word; the vocabulary has the mark alone, so every word can be spelled
        self.starts = np.array([isinstance(p, str) and p.startswith(START) for p in vocabulary.names])
        if START not in vocabulary.index:
            raise ValueError("the vocabulary lacks the start mark")
        keys = np.array([self._key(p) for p in vocabulary.names[: self.first_byte]], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        bits = (4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        # a slot names the first of the sorted keys that fall into it, or none
        places = (self.keys >> self.shift).astype(np.int64)
        for i in range(len(places) - 1, -1, -1):
            self.slot[places[i]] = i
        self.runs = int(np.bincount(places).max())

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mixed(np.array([h], np.uint64))[0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        h = mixed(hashes)
        at = self.slot[(h >> self.shift).astype(np.int64)]
        found = np.full(h.shape, -1, np.int32)
        last = len(self.keys) - 1
        for k in range(self.runs):
            i = np.minimum(at + k, last)
            hit = (at >= 0) & (self.keys[i] == h)
            found[hit] = self.ids[i[hit]]
        return found

    def _arcs(self, codes: np.ndarray, logp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length 1, 2, ...: the piece and its log-probability at each start."""
        arcs = []
        h = np.zeros_like(codes, np.uint64)
        padded = np.append(logp, _NONE)
        for size in range(1, min(self.longest, codes.shape[1]) + 1):
            n = codes.shape[1] - size + 1
            h = h[:, :n] * _STEP + codes[:, size - 1 : size - 1 + n].astype(np.uint64) + np.uint64(1)
            piece = self._find(h)
            arcs.append((piece, padded[piece]))
        return arcs

    def _bytes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct characters and, for each, how often it uses each of the 256 byte pieces."""
        distinct, at = np.unique(codes, return_inverse=True)
        counts = np.zeros((len(distinct), 256))
        for i, c in enumerate(distinct):
            for b in chr(c).encode("utf-8", "surrogateescape"):
                counts[i, b] += 1
        return counts, at.reshape(codes.shape)

    def run(self, codes: np.ndarray, logp: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each row of characters; adds expected counts of pieces if asked."""
        rows, n = codes.shape
        arcs = self._arcs(codes, logp)
        spelled, at = self._bytes(codes)
        by_byte = (spelled @ logp[self.first_byte :])[at]
        by_byte[:, 0] = _NONE  # the start mark is part of a piece
        ahead = np.full((n + 1, rows), _NONE)
        ahead[0] = 0.0
        for end in range(1, n + 1):
            total = ahead[end - 1] + by_byte[:, end - 1]
            for size in range(1, min(len(arcs), end) + 1):
                p = arcs[size - 1][1][:, end - size]
                if (p > _NONE).any():
                    total = np.logaddexp(total, ahead[end - size] + p)
            ahead[end] = total
        if expected is not None:
            back = np.full((n + 1, rows), _NONE)
            back[n] = 0.0
            whole = ahead[n]
            for start in range(n - 1, -1, -1):
                step = by_byte[:, start] + back[start + 1]
                share = np.exp(ahead[start] + step - whole)
                expected[self.first_byte :] += np.bincount(at[:, start], share, len(spelled)) @ spelled
                for size in range(1, min(len(arcs), n - start) + 1):
                    piece, p = arcs[size - 1][0][:, start], arcs[size - 1][1][:, start]
                    used = np.flatnonzero(piece >= 0)
                    if len(used):
                        arc = p[used] + back[start + size][used]
                        share = np.exp(ahead[start][used] + arc - whole[used])
                        expected += np.bincount(piece[used], share, self.size)
                        step[used] = np.logaddexp(step[used], arc)
                back[start] = step
        return ahead[n]

    def words(self, words: list[bytes], logp: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """run() for words of any lengths, each behind the start mark."""
        texts = [START + w.decode("utf-8", "surrogateescape") for w in words]
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts))
        order = np.argsort(sizes, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(sizes[order], prepend=-1)), len(order))
        for a, b in zip(bounds[:-1], bounds[1:]):
            for k in range(a, b, LATTICE_WORDS):
                some = order[k : min(b, k + LATTICE_WORDS)]
                text = "".join(texts[i] for i in some)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), -1)
                out[some] = self.run(codes, logp, expected)
        return out


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def coded(docs: DataFrame) -> DataFrame:
    """One scan to two kinds of rows. Documents: unit, doc_id, held_out and codes, their words as numbers of
    the unit's list. Words: unit, k (the number), word and c (occurrences in training documents).

    Units are stretches of a task's input; they name nothing outside of the written table.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        first = TaskContext.get().partitionId() << 24
        number: dict[bytes, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        unit, held_words = first, 0

        def listed() -> Iterator[pa.RecordBatch]:
            words = list(number)
            for a in range(0, len(words), 50_000):
                some = words[a : a + 50_000]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, unit)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()),
                        pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(some, pa.binary()), pa.array(counts[a : a + m]),
                    ],
                    names=_CODED_NAMES,
                )

        for batch in batches:
            held = batch.column("held_out").to_pylist()
            codes = []
            for i, text in enumerate(byte_column(batch, "text")):
                words = [] if text is None else text.lower().split()
                code = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
                while len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                if not held[i] and len(code):
                    np.add.at(counts, code, 1)
                codes.append((unit, i, pack(code.tobytes())))
                held_words += len(words)
                if held_words > UNIT_WORDS or len(number) > UNIT_DISTINCT:
                    yield from listed()
                    number, held_words, unit = {}, 0, unit + 1
                    counts[:] = 0
            at = pa.array([i for _, i, _ in codes], pa.int64())
            m = len(codes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([u for u, _, _ in codes], pa.int64()), batch.column("doc_id").take(at), batch.column("held_out").take(at),
                    pa.array([c for _, _, c in codes], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                ],
                names=_CODED_NAMES,
            )
        yield from listed()

    return docs.mapInArrow(
        scanned, "unit long, doc_id long, held_out boolean, codes binary, k int, word binary, c long"
    )


_CODED_NAMES = ["unit", "doc_id", "held_out", "codes", "k", "word", "c"]


def spelling(model: Lattice, uses: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Log-probabilities of pieces and of a word's end, from uses of the pieces over so many words.

    A word begins with one of the starting pieces; then each time another piece or the end follows.
    """
    first = np.where(model.starts, uses, 0.0)
    more = np.where(model.starts, 0.0, uses)
    with np.errstate(divide="ignore"):
        logp = np.log(first / first.sum() + more / (more.sum() + words))
    return logp, log(words / (more.sum() + words))


def expected_pieces(words: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the distinct words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        expected = np.zeros(model.size)
        for batch in batches:
            model.words(batch.column("word").to_pylist(), logp, expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(expected[used])], names=["piece", "uses"]
        )

    rows = words.select("word").mapInArrow(counted, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    total = np.zeros(lattice(path).size)
    table = rows.toArrow()  # at most one row for each piece of the vocabulary
    total[table.column("piece").to_numpy()] = table.column("uses").to_numpy()
    return total


def lm_scores(docs: DataFrame, vocabulary: str | None = None, rounds: int = 2) -> DataFrame:
    """Scores of every document by a unigram model of words, unseen ones spelled by pieces.

    Training documents are those whose crc32 of doc_id as text leaves another
    remainder than 1 by 5. Words are lower-cased in A-Z; an end follows the last.

    A token is a training word or the end, by count, with the share 1 - u; with the
    share u it is spelled: its probability is the sum over all segmentations into
    pieces of the existing vocabulary, by a forward recursion in log space. Pieces
    start from the vocabulary's own scores and take `rounds` expectation steps
    over all distinct training words. u is the chance of an unseen word: training
    words seen once, by all tokens.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (additive smoothing over words) and score; both are base-10 logarithms.

    Work: each task numbers the words of its units, one shuffle brings each word's
    counts together, each distinct word passes the lattice once, and its values go
    back to the units that asked. Null or empty text: the end alone. A null id
    counts as training. Very long texts are taken whole. Repeated rows count each.
    Without training documents the pieces alone score. Empty table: no rows.
    """
    path = vocabulary or default_pieces()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"),
    )
    scanned = written(coded(rows), "coded")
    texts = scanned.where("codes IS NOT NULL").select("unit", "doc_id", "held_out", "codes")
    same = Window.partitionBy("word")
    listed = written(
        scanned.where("word IS NOT NULL")
        .select("word", "unit", "k", F.sum("c").over(same).alias("c"), F.row_number().over(same.orderBy("unit", "k")).alias("n"))
        .select("word", "unit", "k", "c", (F.col("n") == 1).alias("first")),
        "words",
    )
    train = listed.where("first AND c > 0")
    sums = train.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()[0]
    ends = texts.where("NOT held_out").count()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    tree = lattice(path)
    logp, stop = spelling(tree, tree.prior, tree.prior[~tree.starts].sum() / 3)
    for _ in range(rounds if sums["v"] else 0):
        uses = expected_pieces(train, path, logp)
        logp, stop = spelling(tree, (1 - PRIOR) * uses + PRIOR * uses.sum() * tree.prior, float(sums["v"]))
    unseen = min(max((sums["once"] or 0) / n, 1 / (n + 1)), n / (n + 1)) if n else 1.0
    share, spelled_share = 1 - unseen, log(unseen) + stop
    base = log(n + 0.5 * (v + 1))
    end_base = log(ends + 0.5) - base
    end_score = log(share * ends / n) if ends else end_base

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            words = batch.column("word").dictionary_encode()
            c = batch.column("c").to_numpy()
            spelled = spelled_share + model.words(words.dictionary.to_pylist(), logp)[words.indices.to_numpy()]
            with np.errstate(divide="ignore"):
                score = np.logaddexp(spelled, np.log(share * c / n) if n else np.full(len(c), _NONE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("unit"), batch.column("k"), batch.column("c"), pa.array(score)], names=["unit", "k", "c", "score"]
            )

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        m = right.num_rows
        k = right.column("k").to_numpy()
        known, word_base, word_score = np.zeros(m, bool), np.zeros(m), np.zeros(m)
        c = right.column("c").to_numpy()
        known[k], word_base[k], word_score[k] = c > 0, np.log(c + 0.5) - base, right.column("score").to_numpy()
        out: list[tuple] = []
        for packed in left.column("codes"):
            codes = np.frombuffer(unpack(packed.as_py()), np.uint32)
            out.append(
                (
                    len(codes) + 1, int(known[codes].sum()) + (ends > 0),
                    (word_base[codes].sum() + end_base) / _LN10, (word_score[codes].sum() + end_score) / _LN10,
                )
            )
        tokens, n_known, base_score, score = zip(*out) if out else ((), (), (), ())
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n] * len(out), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    values = listed.select("word", "unit", "k", "c").mapInArrow(valued, "unit long, k int, c long, score double")
    return (
        texts.groupBy("unit")
        .cogroup(values.groupBy("unit"))
        .applyInArrow(
            scored,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
