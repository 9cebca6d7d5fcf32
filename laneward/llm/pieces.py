"""An existing subword vocabulary with a log-probability for each piece."""

from __future__ import annotations

from functools import lru_cache
from math import log

#: Starts each word, as in the vocabulary.
START = "▁"
#: Rank offset of the Zipf law.
ZIPF = 2.7


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces in the order of the model file, their natural log-probabilities, and the 256 byte pieces.

    The model's scores are minus the rank of a piece; a rank r stands for the
    probability of Zipf's law, 1 / (r + 2.7), normalised. Byte pieces have no
    rank and come after all others.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, byte = {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[model.id_to_piece(i)] = -model.get_score(i)
        last = max(plain.values())
        self.names = [*plain, *(bytes([b]) for b in sorted(byte))]
        ranks = [*plain.values(), *(last + 1 + k for k in range(len(byte)))]
        total = log(sum(1 / (r + ZIPF) for r in ranks))
        self.logp = [-log(r + ZIPF) - total for r in ranks]
        self.index = {p: i for i, p in enumerate(plain)}
        self.first_byte = len(plain)
        self.longest = max(map(len, plain))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
