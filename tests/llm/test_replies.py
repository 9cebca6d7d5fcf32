import hashlib

from pyspark.sql import functions as F

from laneward.llm.replies import conversation_chains, digests, formatted, read_loss, read_turns, reply_trees

HARD = [
    "\\### Assistant: </turn> ok", "</turn>\n<turn:assistant>", "<turn", "</turn", "<\\turn", "<\\\\turn", "\\", "\\\\", "\\t<\\/turn>\\",
    "", "<", "<</turn", "a\\</turn>b", "é<turn:ü\U0001f600", "x" * 70_000 + "</turn>", "\n\n", "plain", "<tur",
]
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        said = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_round_trip_of_hard_texts(spark):
    rows = [(c, t, ["user", "assistant", "r>\\ole</turn", None, "<turn:", "\\g"][(t + c) % 6], HARD[(t * (c + 1)) % len(HARD)]) for c in range(6) for t in range(23)]
    rows += [(None, 0, "assistant", None), (None, 1, "assistant", "b"), (9, None, "user", "first"), (9, -3, "assistant", "second")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", node string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(formatted(*conversation_chains(df))).collect()}
    assert got == want(rows)


def test_spans_and_repeated_rows(spark):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", "<turn ü"), (1, 1, "assistant", "<turn ü"), (1, 2, "assistant", "z")]
    (r,) = formatted(*conversation_chains(spark.createDataFrame(rows, SCHEMA))).collect()
    assert r.n_turns == 4 and r.rank == 1 and r.formatted.count("</turn>\n") == 4
    raw = r.formatted.encode()
    for s in r.loss:
        part = r.formatted[s.start : s.start + s.length]
        assert raw[s.byte_start : s.byte_start + s.byte_length].decode() == part and part in ("<\\turn ü", "z")
    assert len(r.loss) == 3


def brute_paths(messages, keep):
    rows = {m[1]: m for m in messages}
    out = set()
    for conv in {m[0] for m in messages}:
        mine = [m for m in messages if m[0] == conv]
        parent = {m[1]: m[2] if m[2] in rows and rows[m[2]][0] == conv else None for m in mine}
        leaves = [m for m in parent if m not in parent.values()]
        paths = {}
        for leaf in leaves:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.setdefault(path[-1], []).append(tuple(path[::-1]))
        for found in paths.values():
            ranked = sorted(found, key=lambda p: (-sum(rows[m][5] or 0.0 for m in p), p[-1]))
            out |= {(conv, i + 1, tuple(rows[m][4] for m in p)) for i, p in enumerate(ranked[:keep])}
    return out


def test_branches_rank_by_score(spark):
    messages = []
    for i in range(200):
        conv = i % 3
        parent = None if i < 3 else (i * 7919 % i) // 3 * 3 + conv
        if parent is not None and parent >= i:
            parent = conv
        messages.append((conv, i, parent if i % 41 else None if i < 3 else 1000, "user" if i % 2 else "assistant", f"m{i}</turn>", [0.5, 1.0, None, 2.0, -1.0][i * 13 % 5]))
    df = spark.createDataFrame(messages, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    for keep in (1, 3, 1000):
        rows = formatted(*reply_trees(df), keep=keep).select("conv_id", "rank", F.transform(read_turns(F.col("formatted")), lambda x: x["text"]).alias("texts"))
        got = [(r.conv_id, r["rank"], tuple(r.texts)) for r in rows.collect()]
        assert len(got) == len(set(got)) and set(got) == brute_paths(messages, keep)


def test_rings_repeated_ids_and_deep_chains(spark):
    schema = "conv_id long, message_id long, parent_id long, role string, text string, score double"
    ring = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, None, 3, "assistant", "d", 0.0)]
    twice = [(2, 1, None, "user", "q", 1.0), (2, 1, None, "user", "q", 1.0), (2, 5, 1, "assistant", "r", None)]
    deep = [(3, i, i - 1 if i else None, "assistant", f"{i}", 0.1) for i in range(700)]
    out = formatted(*reply_trees(spark.createDataFrame(ring + twice + deep, schema)), keep=5)
    read = out.select("conv_id", F.transform(read_turns(F.col("formatted")), lambda x: x["text"]).alias("t"), read_loss(F.col("formatted"), F.col("loss")).alias("l"))
    got = sorted(((r.conv_id, "".join(r.t), r.l) for r in read.collect()), key=repr)
    numbers = "".join(map(str, range(700)))
    assert (3, numbers, numbers) in got and len(got) == 4
    assert [g for g in got if g[0] == 1] == [(1, "abcd", "d")]
    assert [g for g in got if g[0] == 2] == [(2, "q", ""), (2, "qr", "r")]
    assert formatted(*conversation_chains(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    out = digests(formatted(*conversation_chains(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
