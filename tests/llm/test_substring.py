import random

import pytest

from laneward.llm import substring
from laneward.llm.substring import SuffixAutomaton, remove_repeats, without_repeats


def brute(rows, size):
    """doc_id, text rows to (n_words, kept) for each row."""
    first = {}
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - size + 1):
            if doc is not None:
                g = tuple(words[i : i + size])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").split()
        keep = [True] * len(words)
        for i in range(len(words) - size + 1):
            if doc is not None and first[tuple(words[i : i + size])] < doc:
                keep[i : i + size] = [False] * size
        out.append((doc, len(words), keep.count(False), " ".join(w for w, k in zip(words, keep) if k)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    passages = [[word() for _ in range(r.randint(45, 130))] for _ in range(6)]
    rows = []
    for doc in range(120):
        words = [word() for _ in range(r.randint(0, 120))]
        for p in r.sample(passages, r.randint(0, 3)):
            a = r.randint(0, 20)
            at = r.randint(0, len(words))
            words[at:at] = p[a : len(p) - r.randint(0, 20)]
        rows.append((doc * 3, " ".join(words)))
    rows += [(400 + i, rows[5][1]) for i in range(6)]  # exact copies
    rows += [(7, rows[40][1]), (7, rows[40][1]), (None, rows[40][1]), (900, None), (901, ""), (902, " \n"), (903, "same " * 300)]
    rows += [(904, "same " * 120), (905, "tab\tand\nline " + " ".join(passages[0]) + "\x0bend")]
    return rows


def test_automaton_spans():
    r = random.Random(2)
    for _ in range(30):
        passages = [[r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(3)]
        words = [r.choice("abc") for _ in range(40)]
        held = {tuple(p[i : i + 4]) for p in passages for i in range(len(p) - 3)}
        want = {i + k for i in range(37) if tuple(words[i : i + 4]) in held for k in range(4)}
        got = SuffixAutomaton(passages).spans(words, 4)
        assert {i for a, b in got for i in range(a, b)} == want
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("seed,stream", [(1, 2000), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, stream):
    monkeypatch.setattr(substring, "STREAM", stream)
    monkeypatch.setattr(substring, "SHARD", 50)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tie int, spans string").repartition(4)
    got = sorted((tuple(r) for r in without_repeats(docs).collect()), key=repr)
    assert got == brute(rows, 50)


def test_rows_of_the_stage(spark):
    long = " ".join(f"p{i}" for i in range(80))
    rows = [(1, "a\nb " + long, 9), (2, long, 9), (3, long + " c\nd", 9), (4, "un\ntouched", 9), (5, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in remove_repeats(docs).collect()}
    assert got == {1: ("a\nb " + long, 9), 3: ("c d", 3), 4: ("un\ntouched", 9), 5: (None, 9)}
    assert without_repeats(docs.limit(0)).count() == 0
