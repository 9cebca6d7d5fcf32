"""Conversation structure repair: cheapest edits over an automaton of shared signature suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from laneward.llm.common import numbered, written

#: Rows of one block; a conversation is cut where the row numbers of the whole table pass a multiple of it.
BLOCK_ROWS = 4096
_SPACE = " \t\n\x0b\f\r"

# Letters of a signature, by fault (none, truncated, blank, duplicate) and role (s, u, a, any other).
LETTERS = "ABCDEFGHIJKLMNOP"
ROLES = "sua"
#: Grammar states: nothing yet, after s, after u, after a. What u or a, whichever is due, leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
RIGHT_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_NEVER = 1 << 40


def kept_state(role: int, state: int) -> int | None:
    """The state after keeping a row of a role (its place in ROLES), None if the grammar forbids it."""
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role < 3 and DUE[state] == role + 1 else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[DUE[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, _NEVER) for c in costs)


#: Costs to go behind the last row, by state: START and ASSISTANT may end. The mark tells it from the end of a
#: block that another one follows, whose costs may be the same but where nothing is inserted.
END = (*_with_inserts([0, _NEVER, _NEVER, 0]), 1)


class Automaton:
    """Signatures read from their ends, as an automaton whose nodes are distinct suffixes.

    Signatures come in the order of their reversed strings, so that those with a
    common suffix follow one another: the nodes of that suffix are on the stack and
    are not worked out again. A node holds, for each grammar state, its cost to go
    and the first letter of its best audit; the rest of the audit is that of the
    node and state it leads to. The letters of the possible edits differ, so the
    least letter among the cheapest gives the least audit. Nodes whose costs differ
    by a constant, as nearly all do from some of a few dozen, share their step.
    """

    def __init__(self) -> None:
        self.steps: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], int, str]] = {}

    def step(self, letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, str]:
        """Costs (least one 0), what was taken off them, and best letters before a row, from the costs after it."""
        found = self.steps.get((letter, after))
        if found is None:
            fault, role = divmod(LETTERS.index(letter), 4)
            extra = TRUNCATED if fault == 1 else 0
            edits = []
            for state in range(4):
                ways = {"D": DELETE + after[state]}
                if fault < 2:
                    ways["R"] = REROLE + extra + after[DUE[state]]
                    to = kept_state(role, state)
                    if to is not None:
                        ways["K"] = extra + after[to]
                edits.append(ways)
            costs = _with_inserts([min(ways.values()) for ways in edits])
            best = ""
            for state, ways in enumerate(edits):
                ways["I"] = INSERT + costs[DUE[state]]
                best += min(x for x, c in ways.items() if c <= costs[state] or costs[state] == _NEVER)
            least = min(costs)
            found = tuple(min(c - least, _NEVER) if c < _NEVER else _NEVER for c in costs), least, best
            self.steps[letter, after] = found
        return found

    def solve(self, signatures: Iterator[tuple[tuple[int, ...], str]]) -> Iterator[list[tuple[int, int, str]]]:
        """For each (costs behind it, signature), by state at its start: (cost, state at its end, audit)."""
        last, nodes = (None, ""), []
        for end, text in signatures:
            shared = 0
            if end == last[0]:
                old = last[1]
                most = min(len(old), len(text))
                while shared < most and old[-1 - shared] == text[-1 - shared]:
                    shared += 1
            else:
                nodes = [(end[:4], 0, "")]
            del nodes[shared + 1 :]
            for at in range(shared, len(text)):
                costs, off, _ = nodes[at]
                costs, more, best = self.step(text[-1 - at], costs)
                nodes.append((costs, off + more, best))
            last = (end, text)
            yield [self._audit(nodes, end, text, state) for state in range(4)]

    @staticmethod
    def _audit(nodes: list, end: tuple[int, ...], text: str, state: int) -> tuple[int, int, str]:
        costs, off, _ = nodes[-1]
        if costs[state] >= _NEVER:
            return _NEVER, state, ""
        total, audit, left = costs[state] + off, [], len(text)
        while left:
            edit = nodes[left][2][state]
            audit.append(edit)
            if edit in "IR":
                state = DUE[state]
            elif edit == "K":
                state = kept_state(LETTERS.index(text[-left]) % 4, state)
            left -= edit != "I"
        if end[4]:
            while state in (SYSTEM, USER):
                audit.append("I")
                state = DUE[state]
            return total, state, "".join(audit)
        return total - end[state], state, "".join(audit)


def edits_of(signature: str, state: int, audit: str) -> Iterator[tuple[int, str, str | None]]:
    """For each letter of a block's audit: row in the block (the next one, if inserted), letter, new role or None."""
    row = 0
    for edit in audit:
        role = None
        if edit in "IR":
            state = DUE[state]
            role = "user" if state == USER else "assistant"
        elif edit == "K":
            state = kept_state(LETTERS.index(signature[row]) % 4, state)
        yield row, edit, role
        row += edit != "I"


_SOLVED = "end array<long>, signature string, costs array<long>, ends array<int>, audits array<string>"


def _solved(asked: DataFrame) -> DataFrame:
    """Each distinct (end, signature) once, signatures with a common suffix in the same task."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            ends, texts = batch.column("end").to_pylist(), batch.column("signature").to_pylist()
            found = list(automaton.solve((tuple(e), t) for e, t in zip(ends, texts)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("end"),
                    batch.column("signature"),
                    pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int32())),
                    pa.array([[x[2] for x in f] for f in found], pa.list_(pa.string())),
                ],
                names=["end", "signature", "costs", "ends", "audits"],
            )

    rows = asked.distinct().withColumn("back", F.reverse("signature"))
    ordered = rows.repartitionByRange("end", "back").sortWithinPartitions("end", "back")
    return ordered.select("end", "signature").mapInArrow(solved, _SOLVED)


def _scan(blocks: DataFrame, by: list, state, step, schema: str) -> DataFrame:
    """Walk the blocks of each conversation in order, a row at a time, carrying a small state."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carried = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, carried = row["conv_id"], state
                given, carried = step(row, carried)
                out.append(given)
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", *by).mapInArrow(scanned, schema)


def _long_ends(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, end): the costs behind each block of the conversations that have several.

    A block turns costs behind it into costs before it by least sums: its cost from
    each state at its start to each at its end, worked out with the automaton once for
    each distinct signature and end state. These tables are then walked from the last
    block of a conversation to its first.
    """
    units = [[0 if s == t else _NEVER for s in range(4)] + [0] for t in range(4)]
    unit = F.array(*[F.array(*[F.lit(c).cast("long") for c in u]) for u in units])
    table = _solved(blocks.select(F.explode(unit).alias("end"), "signature")).select(
        "signature", F.array_position("end", F.lit(0).cast("long")).alias("to"), "costs"
    )
    table = table.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("to", "costs"))).alias("table"))  # four
    rows = blocks.select("conv_id", "block", "signature").join(table, "signature").drop("signature")

    def step(row: dict, after: tuple[int, ...] | None) -> tuple[dict, tuple[int, ...]]:
        after = after or END
        before = [min(t["costs"][s] + after[j] for j, t in enumerate(row["table"])) for s in range(4)]
        least = min(before)
        found = {"conv_id": row["conv_id"], "block": row["block"], "end": list(after)}
        return found, (*(min(c - least, _NEVER) if c < _NEVER else _NEVER for c in before), 0)

    key = rows.schema["conv_id"].dataType.simpleString()
    return _scan(rows, [F.desc("block")], None, step, f"conv_id {key}, block long, end array<long>")


def _plans(blocks: DataFrame) -> DataFrame:
    """conv_id, block, first, signature, entry (state at its start), cost, audit of each block."""
    blocks_held = blocks.groupBy("conv_id").agg(F.count("*").alias("held"))
    marked = blocks.join(
        blocks_held.where("held > 1").select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long")),
        F.col("conv_id").eqNullSafe(F.col("long_id")),
        "left",
    ).drop("long_id")
    marked = written(marked, "blocks")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    short, long = marked.where("long IS NULL").drop("long"), marked.where("long").drop("long")
    columns = ["conv_id", "block", "first", "signature"]
    found = _solved(short.select(end.alias("end"), "signature"))
    plans = short.join(found, "signature").select(
        *columns, F.lit(START).alias("entry"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit")
    )
    if long.isEmpty():
        return plans
    ends = _long_ends(long).withColumnRenamed("conv_id", "of")
    here = F.col("conv_id").eqNullSafe(F.col("of")) & (long["block"] == ends["block"])
    asked = written(long.join(ends, here).select(*[long[c] for c in columns], "end"), "asked")
    rows = asked.join(_solved(asked.select("end", "signature")), ["end", "signature"])

    def step(row: dict, state: int) -> tuple[dict, int]:
        given = {c: row[c] for c in columns}
        return given | {"entry": state, "cost": row["costs"][state], "audit": row["audits"][state]}, row["ends"][state]

    key = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, block long, first long, signature string, entry int, cost long, audit string"
    return plans.unionByName(_scan(rows, ["block"], START, step, schema))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest edits that give each conversation the roles (s?(ua)+)?, and the repaired rows.

    Returns a report (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit), one row for each conversation that has rows, and rows (conv_id, first,
    place, edit, role, text), where (first, place) is the order in a conversation.

    Rows go by turn, nulls first, equal turns by role and text hash; a row's first
    fault counts: blank, duplicate (role and text seen earlier), truncated (the last
    character that is no white space is none of .!?). Keep costs 0, Rerole to user or
    assistant 2, Delete 3, Insert an empty row 2, an undeleted truncated row 1 more;
    blank and duplicate rows are deleted. An audit is the letters of its edits; of
    equally cheap ones the least is taken.

    Rows are numbered by range, so a large conversation is in many tasks. Its
    neighbours and its first sightings of a text are found by joins of narrow rows.
    A signature covers at most BLOCK_ROWS rows; the blocks of longer conversations are
    linked by small tables of costs between grammar states.

    Null conv_id: one conversation. Null role, text: one space (so never kept, and
    blank). Null turns are ignored in gaps. Empty table: no rows. A conversation's audit
    is one string and must fit a cell. Other columns are ignored.
    """
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    rows = numbered(rows.withColumn("tie", F.md5(F.col("text").cast("binary"))), ["conv_id", "turn", "role", "tie"], "at")
    bare = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    narrow = written(
        rows.select(
            "at", "conv_id", "turn", initial.alias("initial"), key.alias("key"), (bare == "").alias("blank"),
            (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        ),
        "rows",
    )
    firsts = narrow.groupBy("conv_id", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    before = narrow.select(
        (F.col("at") + 1).alias("at"), F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"),
        F.col("initial").alias("p_initial"), F.lit(True).alias("has"),
    )
    same = F.coalesce(F.col("has") & F.col("conv_id").eqNullSafe(F.col("p_conv")), F.lit(False))
    fault = F.when(F.col("blank"), 2).when(F.col("new").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.col("initial")), F.lit(0)) - 1, F.lit(3))
    role = F.when(F.col("initial") == "", 3).otherwise(role)
    letter = F.substr(F.lit(LETTERS), 4 * fault + role + 1, F.lit(1))
    marked = narrow.join(firsts, "at", "left").join(before, "at", "left").select(
        "at", "conv_id", "turn", letter.alias("letter"), fault.alias("fault"),
        (same & ~F.concat("p_initial", "initial").isin(*RIGHT_PAIRS)).cast("long").alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(same & (F.col("turn") == F.col("p_turn")), F.lit(False))).cast("long").alias("new_turn"),
    )
    count = lambda k: F.sum((F.col("fault") == k).cast("long"))
    blocks = written(
        marked.groupBy("conv_id", F.expr(f"at div {BLOCK_ROWS}").alias("block")).agg(
            F.min("at").alias("first"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("signature"),
            count(2).alias("blank"), count(3).alias("duplicate"), count(1).alias("truncated"),
            F.sum("illegal").alias("illegal"), F.sum("new_turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        ),
        "blocks",
    )
    plans = written(_plans(blocks.select("conv_id", "block", "first", "signature")), "plans")
    sums = ["blank", "duplicate", "truncated", "illegal"]
    counted = blocks.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in sums],
    )
    edited = plans.groupBy(F.col("conv_id").alias("of")).agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    report = counted.join(edited, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return report, _repaired(plans, rows)


def _repaired(plans: DataFrame, rows: DataFrame) -> DataFrame:
    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, plan in enumerate(batch.to_pylist()):
                found = list(edits_of(plan["signature"], plan["entry"], plan["audit"]))
                kept = [(n, *x) for n, x in enumerate(found) if x[1] != "D"]
                if kept:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([plan["conv_id"]] * len(kept), batch.schema.field("conv_id").type),
                            pa.array([plan["first"]] * len(kept), pa.int64()),
                            pa.array([n for n, *_ in kept], pa.int64()),
                            pa.array([plan["first"] + row if x != "I" else None for _, row, x, _ in kept], pa.int64()),
                            pa.array([x for _, _, x, _ in kept]),
                            pa.array([r for *_, r in kept], pa.string()),
                        ],
                        names=["conv_id", "first", "place", "at", "edit", "new_role"],
                    )

    key = plans.schema["conv_id"].dataType.simpleString()
    edited = plans.select("conv_id", "first", "signature", "entry", "audit").mapInArrow(
        edits, f"conv_id {key}, first long, place long, at long, edit string, new_role string"
    )
    columns = ["conv_id", "first", "place", "edit"]
    inserted = edited.where("edit = 'I'").select(*columns, F.col("new_role").alias("role"), F.lit("").alias("text"))
    kept = edited.where("edit != 'I'").join(rows.select("at", "role", "text"), "at")
    return inserted.unionByName(kept.select(*columns, F.coalesce("new_role", "role").alias("role"), "text"))


def repaired_hashes(rows: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its repaired rows, `role:text` joined by line ends; rows are streamed, not gathered."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, kind = None, None, None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for of, role, text in zip(*columns):
                if digest is None or of != conv:
                    if digest is not None:
                        yield given()
                    conv, digest = of, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield given()

    key = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(hashed, f"conv_id {key}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of `conv_id:turn`: 0 drops, 1 empties, 2 takes .!? out, 3 repeats, 4 makes it a user's."""
    space = F.lit(" ")
    string = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fate = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        conversations.select("conv_id", "turn", string("role").alias("role"), string("text").alias("text"), fate.alias("fate"))
        .where("fate != 0")
        .select(
            "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )
