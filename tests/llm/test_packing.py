import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laneward.llm.packing import CapacityTree, first_fit_decreasing, pack, plan
from laneward.llm.wordbpe import WordEncoder, default_vocabulary

TEXTS = [
    "The cat's 12 mats.", "", None, "a\x7fb c \x7f d", "<|endoftext|>x <|startoftext|> it's 'S", "\n\t \x0b",
    "é ́a ΣΑΣ İ ﬁ 日本語 a b\u0085c\x1cd", "long " * 9000, "The cat's 12 mats.",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 16))
def test_plan_holds_every_token_once(lengths, capacity):
    sequences = plan(lengths, capacity)
    assert all(0 < sum(n for _, _, n in s) <= capacity for s in sequences)
    at = dict.fromkeys(range(len(lengths)), 0)
    for doc, start, n in sorted(p for s in sequences for p in s):
        assert start == at[doc] and n > 0
        at[doc] += n
    assert list(at.values()) == lengths


def test_first_fit_takes_the_leftmost_bin():
    sizes = [5, 4, 4, 3, 2, 2]
    bins, rooms = [], []
    for i in sorted(range(6), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
        if k == len(rooms):
            bins.append([])
            rooms.append(7)
        bins[k].append(i)
        rooms[k] -= sizes[i]
    assert first_fit_decreasing(sizes, 7) == bins
    tree = CapacityTree(1, 3)
    assert tree.first(3) == 0


def test_word_encoder_equals_the_library():
    fast, whole = WordEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    for text in TEXTS:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert fast.encode(None if text is None else text.encode()).tolist() == want


def test_pack_round_trip(spark):
    rows = [(i, t, "x", 9) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 9), (None, "no id", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, `group` int")
    out = pack(docs, group_docs=4).collect()
    whole = Tokenizer.from_file(default_vocabulary())
    want = sorted(
        (np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, *_ in rows)
    )
    per_doc = {}
    for r in out:
        per_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    got = []
    for (_, tokens), pieces in per_doc.items():
        copies = sum(p.length for p in pieces) // tokens
        for k in range(copies):
            got.append(b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)[k::copies]))
    assert sorted(got) == want
    by_sequence = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_little_padding(spark, sf_dir):
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    held = [r[1] for r in out]
    assert sum(4096 - n for n in held) < 0.03 * sum(held) + 4096


def test_groups_are_bounded_whatever_the_ids_are(spark):
    null, same = spark.range(1200).selectExpr("CAST(NULL AS long) AS doc_id", "'a b' AS text"), spark.range(900).selectExpr("7 AS doc_id", "'c' AS text")
    other = spark.range(900).selectExpr("id + 10 AS doc_id", "CAST(NULL AS string) AS text")
    out = pack(null.union(same).union(other), group_docs=100).collect()
    held = {}
    for r in out:
        held[r.sequence_id >> 32] = held.get(r.sequence_id >> 32, 0) + (r.start == 0)
    assert sum(held.values()) == 3000 and len(held) == 30 and max(held.values()) < 200
    assert sum(r.doc_id is None for r in out if r.start == 0) == 1200 and sum(r.doc_id == 7 for r in out if r.start == 0) == 900


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digest(spark, sf_dir):
    from laneward.llm.queries import QUERIES

    row = QUERIES["op1_packing"](spark, sf_dir).where("start = 0 AND length = doc_tokens").orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    ids = [*Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids, 2]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
