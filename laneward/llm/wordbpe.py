"""Token ids of whole texts as the tokenizers library gives them, each distinct piece encoded once for a worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps, and those of one more call; about 200 bytes each.
MEMO_PIECES = 750_000
#: A control character that becomes one token of its own and parts the words of one call.
_PART = "\x7f"
_CALL_WORDS = 2000
#: Texts that are encoded together: about so many bytes.
_CALL_BYTES = 1 << 22

# The rules under which a text's ids are those of its words. Other vocabularies take whole texts.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORD_END = "</w>"
#: Latin characters: composed as they stand and lower-cased one by one.
_LATIN = 0x250


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """What stands for each byte in byte-level vocabularies: itself if printable, else a letter from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 10}


def _latin_pieces() -> str:
    """_PIECE for texts of Latin characters, and the end of a line as a piece; letters first, which changes nothing."""
    latin = sorted({low for c in range(_LATIN) for low in chr(c) + chr(c).lower()})
    letters, numbers = (re.escape("".join(c for c in latin if category(c)[0] == kind)) for kind in "LN")
    spaces = "\\t-\\r \\x85\\xa0"
    endings = _PIECE[: _PIECE.index("|[")]
    return rf"[{letters}]+|\n|{endings}|[{numbers}]|[^{spaces}{letters}{numbers}]+"


def _by_words(settings: dict) -> bool:
    """Whether a vocabulary drops white space, cuts by _PIECE and marks the end of each piece."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    steps = pre.get("pretokenizers") or [{}]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": _PIECE}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == _WORD_END
        and not any(model.get(k) for k in ("continuing_subword_prefix", "unk_token", "dropout"))
        and settings.get("post_processor") is None
        and not any(set(t["content"]) & set(" \t\n\x0b\f\r") or t["lstrip"] or t["rstrip"] for t in settings["added_tokens"])
    )


class _Pieces(dict):
    """Numbers of pieces in the order they are met, and the ids of each; piece 0 parts words and has none."""

    def __init__(self) -> None:
        super().__init__({"\n": 0})
        self.new: list[str] = []
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.known = 1

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def store(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids, end to end, of the pieces that follow those known."""
        end = self.known + len(counts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while end > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.known : end] = self.used + np.cumsum(counts) - counts
        self.count[self.known : end] = counts
        self.known = end
        self.used += len(ids)


def _gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and lengths, end to end."""
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


class WordEncoder:
    """Encodes texts; with a vocabulary that never merges across white space, word by word.

    The distinct words of some texts are found by Arrow. Those of Latin letters, digits
    and signs are lower-cased and cut into pieces here; only pieces that the memo does
    not hold pass the library's byte pair encoding. Other words pass the library whole.
    A full memo is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_words = _by_words(settings)
        if not self.by_words:
            return
        (self.part,) = self._ids(_PART)
        self.pairs = Tokenizer.from_file(path)
        self.pairs.normalizer = None
        self.pairs.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        letters = _byte_letters()
        self.letters = "".join(letters.get(b, chr(b)) for b in range(256))
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self.cut = re.compile(_latin_pieces()).findall
        others = "|".join(re.escape(t["content"]) for t in settings["added_tokens"])
        self.hard = re.compile(rf"[^\x00-\x7e\x80-\u{_LATIN - 1:04x}]" + (f"|{others}" if others else "")).search
        self.pieces = _Pieces()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), _CALL_WORDS):
            some = new[i : i + _CALL_WORDS]
            text = "\n".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.asarray(self.pairs.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the end of each piece")
            self.pieces.store(ids, np.diff(ends, prepend=0))

    def _easy(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words parted by line ends, end to end, and how many each has."""
        cut = self.cut(text.lower())
        if len(self.pieces) > MEMO_PIECES:
            self.pieces = _Pieces()
        memo = self.pieces
        at = np.fromiter(map(memo.__getitem__, cut), np.int64, len(cut))
        new, memo.new = memo.new, []
        try:
            self._learn_pieces(new)
        except BaseException:
            self.pieces = _Pieces()  # some numbers have no ids
            raise
        counts = memo.count[at]
        last = np.append(np.flatnonzero(at == 0), len(at))
        ends = np.append(0, np.cumsum(counts))[last]
        return _gathered(memo.flat, memo.start[at], counts), np.diff(ends, prepend=0)

    def _hard(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that the library encodes whole."""
        plain = [i for i, w in enumerate(words) if _PART not in w]
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        for i in range(0, len(plain), _CALL_WORDS):
            some = plain[i : i + _CALL_WORDS]
            ids = np.asarray(self._ids(f" {_PART} ".join(words[j] for j in some)), np.uint32)
            parts = np.flatnonzero(ids == self.part)
            if len(parts) != len(some) - 1:
                raise ValueError("the vocabulary does not keep words apart")
            for j, a, b in zip(some, np.append(-1, parts) + 1, np.append(parts, len(ids))):
                found[j] = ids[a:b]
        for i, word in enumerate(words):
            if _PART in word:
                found[i] = np.asarray(self._ids(word), np.uint32)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some words, and where those of each start and how many they are."""
        text = b"\n".join(words.to_numpy(zero_copy_only=False)).decode("utf-8", "replace")
        if not self.hard(text):
            flat, counts = self._easy(text)
        else:
            texts = text.split("\n")
            hard = np.array([self.hard(t) is not None for t in texts])
            easy = "\n".join(t for t, h in zip(texts, hard) if not h)
            counts = np.zeros(len(texts), np.int64)
            flat, counts[hard] = self._hard([t for t, h in zip(texts, hard) if h])
            order = [np.flatnonzero(hard)]
            if not hard.all():
                more, counts[~hard] = self._easy(easy)
                flat = np.concatenate([flat, more])
                order.append(np.flatnonzero(~hard))
            at = np.concatenate(order)
            starts = np.empty(len(texts), np.int64)
            starts[at] = np.cumsum(counts[at]) - counts[at]
            return flat, starts, counts
        return flat, np.cumsum(counts) - counts, counts

    def encode(self, text: bytes | None) -> np.ndarray:
        """The ids of a UTF-8 text, as unsigned 32-bit; none for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each of some texts."""
        if not self.by_words:
            return [np.asarray([] if t is None else self._ids(t.decode("utf-8", "replace")), np.uint32) for t in texts]
        out, waiting, size = [], [], 0
        for text in texts:
            waiting.append(b"" if text is None else text)
            size += len(waiting[-1])
            if size > _CALL_BYTES:
                out += self._encode_some(waiting)
                waiting, size = [], 0
        return out + self._encode_some(waiting)

    def _encode_some(self, texts: list[bytes]) -> list[np.ndarray]:
        if not any(texts):
            return [np.empty(0, np.uint32) for _ in texts]
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = parts.values.view(pa.large_binary()).dictionary_encode()
        flat, starts, counts = self._distinct(words.dictionary)
        at = words.indices.to_numpy()
        counts = counts[at]
        ends = np.append(0, np.cumsum(counts))[parts.offsets.to_numpy()]
        return np.split(_gathered(flat, starts[at], counts), ends[1:-1])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; kept from task to task."""
    return WordEncoder(path)
