import re

from laneward.llm.quality import RULES, Rule, good_documents, quality

TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x " * 200, ("the of and " * 3 + "q w e r t y u i\n") * 20,
    "# 5 $ | <b> & %\nline\n\nline\nline\r\n \n", "Ñandú ß ÀÉ 日本 \U0001f600 # x\u0085y", "A\x0bB\x0cC\x1cD",
    " ".join(f"w{i % 37}" for i in range(5000)), "a b c d a b c e a b x a b c",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    repeat = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat),
        n < 50 or 100 * len(repeat) > 50 * n,
    )


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        assert r.kept <= (not r.base_failed)


def test_rules_and_rows(spark):
    good = " ".join(f"the plain{i} of and word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good), (1, good), (None, good), (2, good + " %%%" * 200), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept, r.failed) for r in quality(docs).collect()) == [
        (0, True, []), (1, True, []), (1, True, []), (2, False, ["symbols to words"]), (3, False, ["stop words", "mean word length"][::-1]),
    ]
    assert good_documents(docs).count() == 3 and good_documents(docs).columns == docs.columns
    assert quality(docs, [Rule("few", "n_words", "n_lines", most=5.0)]).where("kept").count() == 0
    assert quality(docs, []).where("kept").count() == 4
    assert quality(docs.limit(0)).count() == 0


def test_one_projection_without_python(spark, sf_dir):
    plan = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert RULES


def test_labelled_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality(docs).join(labels, "doc_id")
    assert judged.where("quality = 0 AND kept").count() == 0
    assert judged.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
