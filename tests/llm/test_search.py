import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from laneward.llm import search as module
from laneward.llm.search import Shard, search, terms_of

SCHEMA = "doc_id long, text string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k):
    rows = [(d, Counter(words(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    total, n_docs = sum(n for *_, n in rows), len(rows)
    held = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in rows:
            m = 50 + 50 * n * n_docs // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(words(text)) if t in c
            )
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def some(seed, n, vocabulary, longest):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.randint(0, longest))) for _ in range(n)]


def ranked(spark, docs, items, k):
    out = search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("leaf,shard,block", [(256, 10_000, 4 << 20), (1, 40, 300), (8, 1000, 4 << 20)])
def test_against_brute_force(spark, monkeypatch, leaf, shard, block):
    for name, value in (("LEAF_DOCS", leaf), ("SHARD_DOCS", shard), ("_STEP_DOCS", min(shard, 500)), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(module, name, value)
    docs = [(i * 7 % 600, t) for i, t in enumerate(some(1, 600, 90, 40))] + [(i, "same words W1 w2") for i in range(1000, 1200)]
    items = list(enumerate(some(2, 12, 120, 15))) + [(50, "same"), (51, "Ünknown"), (52, None), (53, "same same w1")]
    assert ranked(spark, docs, items, 7) == brute(docs, items, 7)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(3, "a b"), (3, "a b"), (None, "a b"), (-5, "A-b"), (1, None), (2, " \n"), (4, "é\x7fÉ 7"), (8, "a " * 300_000)]
    items = [(1, "a"), (1, "a"), (None, "b é"), (2, ""), (3, "É!"), (4, "zzz")]
    assert ranked(spark, docs, items, 3) == brute(docs, items, 3)
    assert ranked(spark, docs, [], 3) == [] == ranked(spark, [], items, 3)
    clash = spark.createDataFrame([(1, "a", "x", 2)], SCHEMA + ", item_id string, rank int")
    assert search(clash, clash.select("doc_id", "text", F_item())).count() == 1


def F_item():
    from pyspark.sql import functions as F

    return F.lit(9).alias("item_id")


def test_terms():
    for text in ["Don't_stop 3.5x", "naïve ÀB\U0001f600c", "\x00a\x7fB", "", "A" * 50, "x@y.z[w]{v}`u~"]:
        assert [t.decode() for t in terms_of(text.encode())] == words(text)


def test_range_maxima_and_pruning():
    rng = np.random.default_rng(5)
    docs = np.concatenate([np.sort(rng.choice(5000, 800, replace=False)) for _ in range(30)])
    terms = np.repeat(np.arange(30), 800)
    impacts = rng.integers(1, 50, len(docs))
    impacts[terms == 4] += 10_000
    shard = Shard(5000, docs, terms, impacts, 30)
    for t in range(30):
        a, b = np.sort(rng.choice(801, 2, replace=False)) + shard.first[t]
        assert impacts[shard.most(np.array([a]), np.array([b]))[0]] == impacts[a:b].max()
    offered, best = [], []
    shard.search(np.arange(30), list(range(5000)), best, 10)
    scores = np.bincount(docs, weights=impacts, minlength=5000).astype(int)
    want = sorted(((s, -d) for d, s in enumerate(scores.tolist())), reverse=True)[:10]
    assert sorted(best, reverse=True) == want and not offered
