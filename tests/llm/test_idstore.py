import zlib

import numpy as np
from tokenizers import Tokenizer

from laneward.llm.idstore import id_digests, read_ids, write_ids
from laneward.llm.wordbpe import default_vocabulary


def test_round_trip(spark, tmp_path):
    texts = ["the cat", None, "", "a " * 3000, "the cat", "x\x7fy", "çà"] * 5
    rows = [(37 - i, t, "clash") for i, t in enumerate(texts)] + [(3, "again", "c"), (3, "again", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    path = str(tmp_path / "ids")
    write_ids(docs, path, stripe_bytes=1 << 16, index_rows=1000)
    got = read_ids(spark, path).orderBy("start").collect()
    whole = Tokenizer.from_file(default_vocabulary())
    ids = {}
    at, last = 0, -1
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 1
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
        ids.setdefault(r.doc_id, []).append(list(r.ids))
    want = {}
    for doc, text, _ in rows:
        want.setdefault(doc, []).append([*whole.encode(text or "", add_special_tokens=False).ids, 1])
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    for r in id_digests(read_ids(spark, path)).where("doc_id > 30").collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][0], "<u4").tobytes())


def test_a_lookup_reaches_the_reader(spark, tmp_path, sf_dir):
    path = str(tmp_path / "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = read_ids(spark, path).where("doc_id = 17").select("start", "n_tokens")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "ids#" not in plan.split("ReadSchema")[-1]
    assert found.count() == 1


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert id_digests(read_ids(spark, path)).count() == 0
