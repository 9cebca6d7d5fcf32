import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from laneward.llm import repair as module
from laneward.llm.repair import END, Automaton, damaged, repair, repaired_hashes

WHITE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired rows) by search over all edits."""
    found, done, count = faults(rows), set(), itertools.count()
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", next(count), 0, "", ())]
    while heap:
        cost, audit, _, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (at, state) in done:
            continue
        done.add((at, state))
        name = {"u": "user", "a": "assistant"}[due[state]]
        push = lambda c, e, i, s, row: heapq.heappush(heap, (cost + c, audit + e, next(count), i, s, out + row))
        push(2, "I", at, due[state], ((name, ""),))
        if at < len(rows):
            role, text = rows[at]
            push(3, "D", at + 1, state, ())
            if found[at] not in ("blank", "duplicate"):
                cut = int(found[at] == "truncated")
                push(2 + cut, "R", at + 1, due[state], ((name, text),))
                if role[:1] == due[state] or role[:1] == "s" and state == "":
                    push(cut, "K", at + 1, role[:1], ((role, text),))


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        said = [(r[2], r[3]) for r in rows]
        found, turns = faults(said), {r[1] for r in rows if r[1] is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit, kept = cheapest(said)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def random_table(seed, convs, most):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three", "four?  \n", " ", "", "x" * 3000, "é.", "a\x0b", "so; no"]
    return [
        (conv, rng.choice([None, t, t, t, t + 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", ""]), rng.choice(texts))
        for conv in convs
        for t in range(rng.randint(1, most))
    ]


def got(spark, table, schema=SCHEMA):
    report, rows = repair(spark.createDataFrame(table, schema))
    hashes = {r.conv_id: r.repaired_sha256 for r in repaired_hashes(rows).collect()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*[r[c] for c in names], hashes.get(r.conv_id, empty)) for r in report.collect()}


def test_against_search_over_all_edits(spark):
    table = random_table(1, [*range(60), None], 9)
    assert got(spark, table) == brute(table)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_conversations_of_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(module, "BLOCK_ROWS", size)
    table = random_table(size, [*range(12), None], 14)
    assert got(spark, table) == brute(table)


def test_each_suffix_is_worked_out_once():
    signatures = sorted({"".join(s) for n in range(5) for s in itertools.product("ABCGO", repeat=n)}, key=lambda s: s[::-1])
    automaton, steps = Automaton(), []
    step = automaton.step
    automaton.step = lambda letter, after: steps.append(1) or step(letter, after)
    assert len(list(automaton.solve((END, s) for s in signatures))) == len(signatures)
    assert len(steps) == len(signatures) - 1  # a node for each distinct suffix but the empty one
    assert len(automaton.steps) < 150


def test_damage(spark):
    rows = [(c, t, r, x) for c in (3, 44, None) for t in (None, *range(60)) for r, x in (("assistant", "a. b! c?"), (None, None))]
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if fate == 4 else r, "" if fate == 1 else x.translate({ord(k): None for k in ".!?"}) if fate == 2 else x)
        want += [] if fate == 0 else [row] * (2 if fate == 3 else 1)
    out = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_rows_nulls_long_texts_and_names(spark):
    table = [(1, 0, None, "Hi."), (1, 1, "user", None), (None, None, "system", "Be brief."), (2, 5, "user", "word " * 400_000), (2, 9, "assistant", "ok.")]
    clash = [(*r, "x", 7) for r in table]
    report, rows = repair(spark.createDataFrame(clash, SCHEMA + ", audit string, at int"))
    shown = {r.conv_id: (r.gaps, r.blank, r.truncated, r.cost, r.audit) for r in report.collect()}
    assert shown == {1: (0, 1, 0, 5, "DD")[:3] + (shown[1][3:]), None: (0, 0, 0, shown[None][3], shown[None][4]), 2: (3, 0, 1, 1, "KK")}
    assert got(spark, [(c, t, r or " ", x or " ") for c, t, r, x in table]) == brute([(c, t, r or " ", x or " ") for c, t, r, x in table])
    assert rows.columns == ["conv_id", "first", "place", "edit", "role", "text"]
    report, rows = repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and rows.count() == 0
