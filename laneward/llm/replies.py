"""Chat formatting: reply trees, their best root-to-leaf paths, and one formatted conversation for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneward.llm.common import numbered, written

# The template. A turn is OPEN + role + ">" + text + CLOSE.
OPEN, CLOSE = "<turn:", "</turn>\n"
#: Starts of the control strings, and what stands for them inside texts and roles.
_CONTROLS = {"<turn": "<\\turn", "</turn": "<\\/turn"}
LOSS_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    """A text without control strings: backslashes are doubled, control strings get a single one."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in _CONTROLS.items():
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """The text that escaped() was given: between pairs of backslashes each single one goes."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\"), F.lit(""))), "\\")


def escaped_role(role: Column) -> Column:
    """A role as it stands in the template; ">" ends it, so it holds none."""
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    plain = F.transform(
        parts, lambda x: F.replace(F.replace(x, F.lit("\\g"), F.lit(">")), F.lit("\\"), F.lit(""))
    )
    return F.array_join(plain, "\\")


def _turns(messages: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return messages.select(
        "node",
        "conv_id",
        F.concat(F.lit(OPEN), escaped_role(role), F.lit(">")).alias("head"),
        text.alias("body"),
        role.isin(*LOSS_ROLES).alias("loss"),
    )


def conversation_chains(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of turns as reply trees: each row answers the row before it in its conversation.

    Returns messages (node, conv_id, role, text) and links (node, parent, score).
    Rows go by turn, nulls first, equal turns by role and text hash.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("tie"))
    messages = numbered(rows, ["conv_id", "turn", "role", "tie"], "node").select("node", "conv_id", "role", "text")
    before = messages.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("before"))
    links = (
        messages.select("node", "conv_id")
        .join(before.withColumn("any", F.lit(True)), "node", "left")
        .select(
            "node",
            F.when(F.col("any") & F.col("conv_id").eqNullSafe(F.col("before")), F.col("node") - 1).alias("parent"),
            F.lit(0.0).alias("score"),
        )
    )
    return messages, links


def reply_trees(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of messages (conv_id, message_id, parent_id, role, text, score) as reply trees.

    A parent that is null or not among the messages of the conversation makes a
    root. Of messages that repeat an id the first by score, role and text gets the
    replies, the others stay as branches without replies.
    """
    rows = messages.select(
        "conv_id", "message_id", "parent_id", "role", "text", F.col("score").cast("double").alias("score"),
        F.md5(F.col("text").cast("binary")).alias("tie"), (-F.col("score").cast("double")).alias("down"),
    )
    rows = numbered(rows, ["conv_id", "message_id", "down", "role", "tie"], "node")
    parents = rows.groupBy("conv_id", F.col("message_id").alias("parent_id")).agg(F.min("node").alias("parent"))
    parents = parents.where("parent_id IS NOT NULL").withColumnRenamed("conv_id", "parent_conv")
    same = F.col("conv_id").eqNullSafe(F.col("parent_conv"))
    asked = rows.select("node", "conv_id", F.col("parent_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    links = asked.join(parents, (asked["parent_id"] == parents["parent_id"]) & same, "left")
    return rows.select("node", "conv_id", "role", "text"), links.select("node", "parent", "score")


def ancestry(nodes: DataFrame, sums: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Depth, root and sums over all ancestors of each node (node, parent, ...), itself included.

    Each round joins the nodes with themselves: who knows its ancestor at distance
    2**j learns that of distance 2**(j + 1) and adds up what lies between, so rounds
    grow with the logarithm of the depth. Also returns, for each round, the
    ancestors known before it (node, far); the first are the links. Where ancestors
    go round in a ring, the link of its least node is cut, which makes it a root.
    """
    names, own = ["depth", *sums], F.col("node")
    state = written(
        nodes.select("node", F.col("parent").alias("far"), own.alias("root"), own.alias("least"), F.lit(1).cast("long").alias("depth"), *sums),
        "ancestry",
    )
    n, levels = state.count(), []
    while not state.where("far IS NOT NULL").isEmpty():
        if 1 << len(levels) > n:
            # more steps than there are nodes end on the rings, and on every node of them
            on_ring = state.select(F.col("far").alias("node")).where("node IS NOT NULL").distinct()
            least = state.where("least = node").join(on_ring, "node").select("node", F.lit(True).alias("cut"))
            kept = nodes.join(least, "node", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent")))
            return ancestry(kept.drop("cut"), sums)
        waiting = state.where("far IS NOT NULL")
        levels.append(waiting.select("node", "far"))
        up = state.select(
            F.col("node").alias("far"), F.col("far").alias("_far"), F.col("root").alias("_root"), F.col("least").alias("_least"),
            *[F.col(c).alias(f"_{c}") for c in names],
        )
        stepped = waiting.join(up, "far").select(
            "node", F.col("_far").alias("far"), F.col("_root").alias("root"), F.least("least", "_least").alias("least"),
            *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names],
        )
        state = written(state.where("far IS NULL").unionByName(stepped), "ancestry")
    return state.drop("far", "least"), levels


def formatted(messages: DataFrame, links: DataFrame, keep: int = 1) -> DataFrame:
    """One row for each of the `keep` best root-to-leaf paths of each tree: its formatted conversation.

    Columns: conv_id, leaf (number of the path's last message), rank (from 1), score
    (sum over the path), n_turns, formatted, and loss: spans of the texts of
    LOSS_ROLES in the formatted conversation, each with start and length in code
    points and byte_start and byte_length in UTF-8. messages: node, conv_id, role,
    text; links: node, parent, score (as conversation_chains and reply_trees give).
    Equal scores rank by leaf number.

    The place of a turn in its conversation is a sum over its ancestors, so it comes
    from the same self-joins as depth and score. The chosen leaves then fetch their
    paths from the ancestors of each round. A formatted conversation is one string
    and must fit a cell; nothing else is gathered by conversation.

    Null role or text: empty. Null score: 0. Empty table: no rows.
    """
    turns = _turns(messages)
    size = {
        "chars": F.length("head") + F.length("body") + len(CLOSE),
        "bytes": F.octet_length("head") + F.octet_length("body") + len(CLOSE),
    }
    sizes = turns.select("node", *[c.cast("long").alias(k) for k, c in size.items()])
    scored = links.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tree = written(scored.join(sizes, "node"), "tree")
    state, levels = ancestry(tree, ["score", "chars", "bytes"])
    order = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    leaves = state
    if levels:
        leaves = state.join(levels[0].select(F.col("far").alias("node")).distinct(), "node", "left_anti")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    path = leaves.select(F.col("node").alias("leaf"), "rank", F.col("score").alias("total"), "node")
    for level in reversed(levels):
        path = path.join(level, "node", "left").select(
            "leaf", "rank", "total", F.explode(F.array_compact(F.array("node", "far"))).alias("node")
        )
    parts = path.join(state.select("node", "depth", "chars", "bytes"), "node").join(turns, "node")
    start = F.col("chars") - F.length("body") - len(CLOSE)
    byte_start = F.col("bytes") - F.octet_length("body") - len(CLOSE)
    part = F.struct(
        "depth",
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
        "loss",
        F.struct(
            start.alias("start"),
            F.length("body").cast("long").alias("length"),
            byte_start.alias("byte_start"),
            F.octet_length("body").cast("long").alias("byte_length"),
        ).alias("span"),
    )
    gathered = parts.groupBy("leaf").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("rank").alias("rank"),
        F.first("total").alias("score"),
        F.array_sort(F.collect_list(part)).alias("turns"),
    )
    return gathered.select(
        "conv_id",
        "leaf",
        "rank",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["span"]).alias("loss"),
    )


def read_turns(conversation: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(conversation, CLOSE)
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    parts = F.transform(bodies, lambda x: F.struct(F.substring_index(x, ">", 1).alias("role"), x.alias("rest")))
    return F.transform(
        parts,
        lambda x: F.struct(
            unescaped_role(x["role"]).alias("role"),
            unescaped(F.substr(x["rest"], F.length(x["role"]) + 2)).alias("text"),
        ),
    )


def read_loss(conversation: Column, loss: Column) -> Column:
    """The texts under the loss spans of a formatted conversation, one after another."""
    whole = conversation.cast("binary")
    cut = lambda x: F.substr(whole, (x["byte_start"] + 1).cast("int"), x["byte_length"].cast("int"))
    return F.array_join(F.transform(loss, lambda x: unescaped(cut(x).cast("string"))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What formatted() wrote, read back from the strings and spans: counts and hashes of turns and loss text."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    read = conversations.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text")
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
