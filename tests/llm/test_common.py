import pytest
import numpy as np
from pyspark.sql import functions as F

from laneward.llm.common import IdFilter, let, sliding_min, window_hashes, word_hashes
from laneward.llm import components as module
from laneward.llm.components import components


def test_window_hashes_depend_on_the_words_alone():
    words = [b"w%d" % (i % 7) for i in range(200)]
    for size in (1, 2, 5, 8, 43, 50):
        found = window_hashes(word_hashes(words), size)
        assert len(found) == 201 - size
        by_words = {}
        for i, h in enumerate(found):
            assert by_words.setdefault(tuple(words[i : i + size]), h) == h
        assert len(set(by_words.values())) == len(by_words)
    assert len(window_hashes(word_hashes(words[:4]), 5)) == 0


def test_sliding_min():
    values = np.random.default_rng(1).random(100)
    for width in (1, 2, 7, 43, 100):
        assert sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(101 - width)]
    assert len(sliding_min(values, 101)) == 0


def test_let_binds_once(spark):
    df = spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("y"))
    assert [r.y for r in df.orderBy("y").collect()] == [1, 4, 9]


def test_id_filter_never_misses(spark):
    docs = spark.range(1000).select((F.col("id") * 7).alias("doc_id"), F.lit(1).alias("_slot2"))
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    some, rest = IdFilter.of(ids, "doc_id").parted(docs, "doc_id")
    assert some.columns == docs.columns
    held = {r.doc_id for r in some.collect()}
    assert {r.doc_id for r in ids.collect()} <= held
    assert len(held) + rest.count() == 1000
    none = IdFilter.of(ids.where("doc_id < 0"), "doc_id")
    assert none.passing(docs, "doc_id").count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)] + [(5, None), (7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("down", [False, True])
def test_ordered_chains_take_logarithmic_rounds(spark, monkeypatch, down):
    rounds, moves = [], module._moves
    monkeypatch.setattr(module, "_moves", lambda left, turn: rounds.append(turn) or moves(left, turn))
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + (-1 if down else 1)).alias("b"))
    star = spark.range(50_000, 60_000).select(F.col("id").alias("a"), F.lit(70_000).alias("b"))
    out = components(chain.unionByName(star))
    want = {(-1 if down else 0, n + 1), (50_000, 10_001)}
    assert {(r.component, r["count"]) for r in out.groupBy("component").count().collect()} == want
    assert len(rounds) <= 14
