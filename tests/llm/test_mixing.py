import numpy as np

from laneward.llm.mixing import CEILINGS, marginal, mixture, rake, sampled


def test_rake_meets_all_marginals():
    cells = {("a", "x"): 5.0, ("a", "y"): 1.0, ("b", "x"): 2.0, ("b", "y"): 8.0}
    weights = rake(cells, [{"a": 0.3, "b": 0.7}, {"x": 0.6, "y": 0.4}], 200)
    mass = {k: cells[k] * w for k, w in weights.items()}
    assert np.isclose(mass["a", "x"] + mass["a", "y"], 0.3) and np.isclose(mass["a", "x"] + mass["b", "x"], 0.6)
    odds = lambda m: m["a", "x"] * m["b", "y"] / m["a", "y"] / m["b", "x"]
    assert np.isclose(odds(mass), odds(cells))
    assert rake({}, [{}, {}]) == {}


def test_marginal_cuts_to_ceilings():
    assert marginal({"a": 6.0, "*": 4.0}, {"a": 0.2}) == {"a": 0.2, "*": 0.8}
    assert marginal({"a": 1.0, "*": 9.0}, {"a": 0.2}) == {"a": 0.1, "*": 0.9}
    assert marginal({"a": 6.0}, {"a": 0.2}) == {"a": 1.0}


def test_sample_has_the_target_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixture(docs).toPandas()
    assert len(rows) == docs.count() and ((rows.probability >= 0) & (rows.probability <= 1)).all()
    assert np.isclose(rows.probability.max(), 1)
    expected = rows.probability * rows.n_tokens
    for column, ceilings in CEILINGS.items():
        for value, most in ceilings.items():
            natural = rows.n_tokens[rows[column] == value].sum() / rows.n_tokens.sum()
            assert np.isclose(expected[rows[column] == value].sum() / expected.sum(), min(natural, most), atol=1e-4)
    assert abs(rows.kept.sum() - rows.probability.sum()) < 4 * np.sqrt(len(rows))
    kept = sampled(docs)
    assert kept.columns == docs.columns and kept.count() == rows.kept.sum()


def test_rows(spark):
    schema = "doc_id long, text string, lang string, source string, topic int, n_tokens string"
    rows = [(1, "a b", "en", "src0", 1, "c"), (2, None, None, None, 1, "c"), (3, "", "en", "s", 1, "c"), (None, "x y", "fr", None, 1, "c")]
    docs = spark.createDataFrame(rows + rows[:1], schema)
    got = mixture(docs).collect()
    assert len(got) == 5 and {r.doc_id: r.probability for r in got}[2] == 0.0
    assert len({(r.doc_id, r.kept) for r in got}) == 4
    assert sampled(docs).columns == docs.columns
    assert mixture(docs.limit(0)).count() == 0


def test_any_hot_value_is_cut(spark):
    hot = [("big", "xx")] * 60 + [(None, "yy")] * 30 + [("*", "zz")] * 30 + [(f"s{i % 40}", f"l{i % 8}") for i in range(80)]
    rows = [(i, "a b c " * (1 + i % 3) * (150 if i % 5 else 1), lang, source) for i, (source, lang) in enumerate(hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixture(docs).toPandas().fillna({"source": "null"})
    got["expected"] = got.probability * got.n_tokens
    for column, ceiling in (("source", 0.2), ("lang", 0.55)):
        shares = got.groupby(column).expected.sum() / got.expected.sum()
        assert shares.max() < ceiling * 1.002 and (shares > 0).all(), shares
    assert len(got) == 200 and (got.groupby("source").expected.sum() / got.expected.sum())["big"] > 0.199


def test_hot_language_and_few_sources(spark):
    rows = [(i, "w " * 400, "de" if i % 10 else "fr", "x" if i % 4 else "y") for i in range(80)]
    got = mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    got["expected"] = got.probability * got.n_tokens
    assert np.isclose(got.expected[got.lang == "de"].sum() / got.expected.sum(), 0.55, atol=1e-3)
    assert np.isclose(got.expected[got.source == "x"].sum() / got.expected.sum(), 0.5, atol=1e-3)
