import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from laneward.llm import wordbpe
from laneward.llm.wordbpe import WordEncoder, default_vocabulary

TEXTS = [
    "", " \n\t", "Don't they'RE 'S I'LL d'd ''s 'dx", "a1b22 ½x² 3.14 $%^&*--__", "ÀÉÎÕÜß İstanbul ŒUVRE ŉ ǅ ȺȾ", "é Å ͅx",
    "日本語 текст ΣΑΣ ﬁ Å \U0001f600‍\U0001f680", "a b c\u0085d e​f", "x\x00y \x1c\x1d\x1e\x1f \x7f a\x7fb \x7f\x7f",
    "<|endoftext|> a<|startoftext|>b <|EndOfText|> <|", "line\r\nline\x0b\x0cend", "w" * 5000, "ab" * 300 + "ÿ" * 100, "﻿x �",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_vocabulary())


def check(encoder, whole, text):
    assert encoder.encode(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_hard_texts(whole):
    encoder = WordEncoder(default_vocabulary())
    for text in TEXTS + TEXTS:
        check(encoder, whole, text)
    assert encoder.encode(None).tolist() == [] and encoder.encode(b"a\xff b").tolist() == whole.encode("a� b", add_special_tokens=False).ids


def test_every_latin_character_and_random_words(whole):
    encoder, rng = WordEncoder(default_vocabulary()), random.Random(3)
    for c in map(chr, range(0x300)):
        check(encoder, whole, f"{c} x{c} {c}{c}y '{c} {c}'s")
    letters = [chr(c) for c in range(1, 0x24F)] + list("abcdefghij'  \n1$") * 12
    for _ in range(300):
        check(encoder, whole, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def test_full_memo_is_forgotten(whole, monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMO_PIECES", 50)
    encoder, rng = WordEncoder(default_vocabulary()), random.Random(4)
    for i in range(200):
        check(encoder, whole, " ".join(f"w{rng.randint(0, 400)} The x{i} é{i % 7} 語{i % 5}" for _ in range(rng.randint(1, 30))))
        assert len(encoder.pieces) < 200


def test_many_texts_at_once(whole, monkeypatch):
    monkeypatch.setattr(wordbpe, "_CALL_BYTES", 300)
    monkeypatch.setattr(wordbpe, "_CALL_WORDS", 3)
    texts = [t.encode() for t in TEXTS * 2] + [None, b"", b"  ", b"x" * 2000, b" a ", b"\xff"]
    for some in (texts, texts[::-1], [None], [b" "], []):
        want = [[] if t is None else whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in some]
        assert [x.tolist() for x in WordEncoder(default_vocabulary()).encode_all(some)] == want


def test_other_vocabularies_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, other = WordEncoder(path), Tokenizer.from_file(path)
    for text in TEXTS + ["two  spaces\n\n and more"]:
        assert np.array_equal(encoder.encode(text.encode()), other.encode(text, add_special_tokens=False).ids)
