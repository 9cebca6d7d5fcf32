import random

import numpy as np
import pytest

from laneward.llm import prefix_join
from laneward.llm.prefix_join import PrefixTree, least_overlap, one_of_each, similar_groups


def grams(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    known = [(d, grams(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in known}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            k = len(x & y)
            if k and 100 * k >= 80 * (len(x) + len(y) - k):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(grams(t)), None if d is None else find(d)) for d, t in rows), key=repr)


def corpus(seed, bases=12, copies=9):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows, doc = [], 1000
    for _ in range(bases):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 160))]
        if r.random() < 0.6:
            words += passage
        for _ in range(copies):
            for _ in range(r.choice((0, 1, 1, 2, 6))):  # a chain of edits
                words = list(words)
                words[r.randrange(len(words))] = f"e{r.randint(0, 9)}"
            rows.append((doc - r.randint(0, 900) * 1000, " ".join(words)))
            doc += 1
    rows += [(1, "a b c"), (2, "A  b\nC"), (3, "a b"), (4, None), (5, ""), (6, " \n"), (7, "x " * 400), (8, "X " * 90)]
    rows += [(9, rows[0][1]), (9, rows[0][1]), (None, rows[0][1]), (10, rows[0][1].upper()), (11, "a b c d e"), (12, "a b c d e")]
    return rows


@pytest.mark.parametrize("seed,sets", [(1, 512), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, sets):
    monkeypatch.setattr(prefix_join, "TREE_SETS", sets)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, n string, leader int").repartition(5)
    assert sorted((tuple(r) for r in similar_groups(docs).collect()), key=repr) == brute(rows)


def test_tree_finds_every_similar_set():
    r = np.random.default_rng(4)
    base = np.sort(r.choice(10_000, 200, replace=False)).astype(np.uint64)
    sets = [np.sort(r.choice(base, r.integers(150, 201), replace=False)) for _ in range(40)]
    sets += [np.sort(r.choice(10_000, 120, replace=False)).astype(np.uint64) for _ in range(40)]
    tree = PrefixTree(sets)
    for x in sets:
        want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert set(tree.similar(x, 80, lambda j: False)) == want
    for n in range(1, 60):
        for m in range(1, 60):
            assert least_overlap(n, m, 80) == min(k for k in range(n + m) if 100 * k >= 80 * (n + m - k))


def test_stage_keeps_one_of_each(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, row string").repartition(3)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted([str(d) for d in {d for d, _, c in brute(rows) if d == c and d is not None}] + ["None"])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert one_of_each(docs.limit(0)).count() == 0
