import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from laneward.llm.mixing import mixture
from laneward.llm.quality import quality
from laneward.llm.wordbpe import default_vocabulary
from test_prefix_join import brute as brute_groups
from test_substring import brute as brute_repeats


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()} if name != "quality_rules" else {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            want = {r.doc_id: before[r.doc_id].text for r in quality(docs).where("kept").collect()}
        elif name == "near_duplicates":
            want = {d: before[d].text for d, _, c in brute_groups([(r.doc_id, r.text) for r in before.values()]) if d == c}
        elif name == "repeated_passages":
            cut = brute_repeats([(r.doc_id, r.text) for r in before.values()], 50)
            want = {d: kept if gone else before[d].text for d, n, gone, kept in cut if gone < n or not n}
        elif name == "source_mixing":
            want = {r.doc_id: before[r.doc_id].text for r in mixture(out).where("kept").collect()}
        out = corpus_pipeline.written(stage(spark, out, sf_dir), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert {r.doc_id: r.text for r in out.collect()} == want
    whole = Tokenizer.from_file(default_vocabulary())
    ids = {}
    for r in out.orderBy("doc_id", "start").collect():
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {
        d: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in want.items()
    }
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and corpus_pipeline.ORACLE_SQL is None
