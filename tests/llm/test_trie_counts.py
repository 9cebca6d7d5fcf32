import numpy as np

from laneward.llm.pieces import START, default_pieces, pieces
from laneward.llm.trie_counts import TrieCounter, token_counts


def brute(word):
    p = pieces(default_pieces())
    text = START + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        raw = text[end - 1].encode()
        options = [(best[end - 1][0] + sum(p.logp[p.first_byte + b] for b in raw), best[end - 1][1] + len(raw))]
        for start in range(end):
            if text[start:end] in p.index:
                options.append((best[start][0] + p.logp[p.index[text[start:end]]], best[start][1] + 1))
        best[end] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][1], best[-1][0]


WORDS = ["the", "then", "thenable", "ß", "日本", "x" * 60, "a", "The,", "12", "\U0001f600", "ñandú", "thenabler", "\x00"]


def test_shared_prefixes_equal_single_words():
    found = TrieCounter(default_pieces()).walk([w.encode() for w in WORDS])
    for (count, score), word in zip(found, WORDS):
        want = brute(word)
        assert count == want[0] and np.isclose(score, want[1])


def test_documents(spark):
    text = " ".join(WORDS)
    rows = [(1, text, 5), (2, text * 3, 5), (3, None, 5), (4, " \n", 5), (None, "the", 5), (1, text, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts(docs).collect())
    one = sum(brute(w)[0] for w in WORDS)
    three = sum(brute(w)[0] for w in (text * 3).split())
    assert got == [(0, 1, brute("the")[0]), (1, 13, one), (1, 13, one), (2, len((text * 3).split()), three), (3, 0, 0), (4, 0, 0)]
    assert token_counts(docs.limit(0)).count() == 0


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    memo = {}
    for r in token_counts(docs).where("doc_id < 60").collect():
        words = texts[r.doc_id].split()
        assert r.n_tokens == sum(memo.setdefault(w, brute(w))[0] for w in words) and r.n_words == len(words)
