import zlib
from collections import Counter
from math import log

import numpy as np

from laneward.llm.lattice import PRIOR, lattice, lm_scores, spelling
from laneward.llm.pieces import START, default_pieces, pieces

WORDS = ["the", "ß", "ñoscomente", "a", "ththerean,", "日本", "x" * 40, "\U0001f600"]


def arcs(text, logp):
    p = pieces(default_pieces())
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in p.index:
                yield start, end, [p.index[text[start:end]]]
        if end > 1:
            yield end - 1, end, [p.first_byte + b for b in text[end - 1].encode()]


def forward(word, logp):
    text = START + word
    ahead = np.full(len(text) + 1, -np.inf)
    ahead[0] = 0
    for start, end, ids in arcs(text, logp):
        ahead[end] = np.logaddexp(ahead[end], ahead[start] + sum(logp[i] for i in ids))
    return ahead


def uses(word, logp):
    text = START + word
    ahead, back = forward(word, logp), np.full(len(text) + 1, -np.inf)
    back[-1] = 0
    for start, end, ids in sorted(arcs(text, logp), key=lambda a: (-a[0], -a[1])):
        back[start] = np.logaddexp(back[start], back[end] + sum(logp[i] for i in ids))
    out = np.zeros(len(logp))
    for start, end, ids in arcs(text, logp):
        share = np.exp(ahead[start] + back[end] + sum(logp[i] for i in ids) - ahead[-1])
        for i in ids:
            out[i] += share
    return out


def test_recursions_against_single_words():
    model = lattice(default_pieces())
    logp = np.log(model.prior)
    expected = np.zeros(model.size)
    got = model.words([w.encode() for w in WORDS], logp, expected)
    assert np.allclose(got, [forward(w, logp)[-1] for w in WORDS])
    assert np.allclose(expected, sum(uses(w, logp) for w in WORDS))
    assert len(model.words([], logp)) == 0


def model_of(rows):
    """The whole model by brute force."""
    model = lattice(default_pieces())
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    words = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() for _, t in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    logp, stop = spelling(model, model.prior, model.prior[~model.starts].sum() / 3)
    for _ in range(2):
        total = sum(uses(w, logp) for w in c)
        logp, stop = spelling(model, (1 - PRIOR) * total + PRIOR * total.sum() * model.prior, float(len(c)))
    u = min(max(sum(x == 1 for x in c.values()) / n, 1 / (n + 1)), n / (n + 1))
    base = log(n + 0.5 * (v + 1))
    out = []
    for (d, _), h, ws in zip(rows, held, words):
        b = log(ends + 0.5) - base + sum(log(c[w] + 0.5) - base for w in ws)
        s = log((1 - u) * ends / n)
        for w in ws:
            s += np.log((1 - u) * c[w] / n + u * np.exp(stop + forward(w, logp)[-1]))
        out.append((d, h, len(ws) + 1, 1 + sum(c[w] > 0 for w in ws), n, round(b / log(10), 6), round(float(s / log(10)), 6)))
    return sorted(out, key=repr)


def test_scores_against_brute_force(spark, monkeypatch):
    from laneward.llm import lattice as module

    rows = [(i, f"the cat THE {'mat ' * (i % 4)}w{i % 6} Ñandú-{i}") for i in range(25)]
    rows += [(30, None), (31, ""), (None, "no id here"), (3, rows[3][1]), (32, "unseen " + "x" * 30)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, unit string, codes int").repartition(3)
    for size in (400_000, 5):
        monkeypatch.setattr(module, "UNIT_DISTINCT", size)
        got = sorted(
            ((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(docs).collect()), key=repr
        )
        assert got == model_of(rows)


def test_without_training_documents(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "the cat")], "doc_id long, text string")
    (r,) = lm_scores(docs).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) and r.n_tokens == 3
    assert lm_scores(docs.limit(0)).count() == 0


def test_known_text_is_likelier_than_shuffled_letters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = lm_scores(docs).groupBy("held_out").sum("score", "n_tokens").collect()
    per_token = {r.held_out: r["sum(score)"] / r["sum(n_tokens)"] for r in total}
    assert -7 < per_token[True] < per_token[False] < -2
