"""Token counts by dynamic programming over a trie of the distinct words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneward.llm.common import byte_column
from laneward.llm.pieces import START, default_pieces, pieces

#: Distinct words that wait for one walk of the trie, and words a worker remembers.
WALK_WORDS = 100_000
MEMO_WORDS = 1_000_000


class TrieCounter:
    """Best segmentations of words, computed once for each prefix that words share."""

    def __init__(self, path: str):
        vocabulary = pieces(path)
        self.logp = dict(zip(vocabulary.names[: vocabulary.first_byte], vocabulary.logp))
        self.byte = vocabulary.logp[vocabulary.first_byte :]
        self.longest = vocabulary.longest
        self.memo: dict[bytes, tuple[int, float]] = {}

    def walk(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(tokens, log-probability) of the best segmentation of each word.

        Words in sorted order are a depth-first walk of their trie: what two
        neighbours share is the path to their branching node, and scores along
        the path stay in place. Among equal scores the fewest tokens count, and
        a character may be spelled by its bytes.
        """
        texts = [w.decode("utf-8", "surrogateescape") for w in words]
        found: list[tuple[int, float]] = [(0, 0.0)] * len(words)
        score, count, path = [0.0], [0], START
        self._extend(path, 0, score, count)
        for i in sorted(range(len(texts)), key=texts.__getitem__):
            text = START + texts[i]
            shared = len(commonprefix((path, text)))
            del score[shared + 1 :], count[shared + 1 :]
            self._extend(text, shared, score, count)
            path = text
            found[i] = (count[-1], score[-1])
        return found

    def _extend(self, text: str, done: int, score: list[float], count: list[int]) -> None:
        logp, longest = self.logp, self.longest
        for end in range(done + 1, len(text) + 1):
            raw = text[end - 1].encode("utf-8", "surrogateescape")
            best = score[end - 1] + sum(self.byte[b] for b in raw)
            least = count[end - 1] + len(raw)
            for start in range(max(0, end - longest), end):
                p = logp.get(text[start:end])
                if p is not None:
                    s = score[start] + p
                    if s > best or s == best and count[start] + 1 < least:
                        best, least = s, count[start] + 1
            score.append(best)
            count.append(least)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        self.memo.update(zip(new, self.walk(new)))


@lru_cache(maxsize=1)
def counter(path: str) -> TrieCounter:
    return TrieCounter(path)


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Tokens of each document under the most likely segmentation of its words.

    Returns doc_id, n_words, n_tokens and score (natural log-probability of the
    best segmentation). Each task gathers the distinct words of some documents,
    walks their trie and stores a count at each word's node; documents add up
    the counts of their words. Nothing is shuffled.

    Null or empty text: zeros. Very long texts are taken whole. Repeated rows
    count each. Null ids stay. Columns other than doc_id and text are ignored.
    """
    model = model or default_pieces()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = counter(model)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            wait: list[list[bytes]] = []
            fresh: set[bytes] = set()
            first = 0
            for text in byte_column(batch, "text"):
                words = [] if text is None else text.split()
                wait.append(words)
                fresh.update(words)
                if len(fresh) > WALK_WORDS:
                    yield _sums(trie, ids[first : first + len(wait)], wait, fresh)
                    first += len(wait)
                    wait, fresh = [], set()
            if wait:
                yield _sums(trie, ids[first:], wait, fresh)

    return rows.mapInArrow(counted, "doc_id long, n_words long, n_tokens long, score double")


def _sums(trie: TrieCounter, ids: list, texts: list[list[bytes]], fresh: set[bytes]) -> pa.RecordBatch:
    trie.learn(fresh)
    memo = trie.memo
    counts = np.zeros(len(texts), np.int64)
    scores = np.zeros(len(texts))
    for i, words in enumerate(texts):
        if words:
            found = [memo[w] for w in words]
            counts[i] = sum(c for c, _ in found)
            scores[i] = sum(s for _, s in found)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(counts), pa.array(scores)],
        names=["doc_id", "n_words", "n_tokens", "score"],
    )
