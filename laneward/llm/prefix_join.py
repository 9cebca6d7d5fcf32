"""Similarity join on sets of word n-grams by prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneward.llm.common import IdFilter, byte_column, mixed, window_hashes, word_hashes, written
from laneward.llm.components import components
from laneward.operators.joins import lookup_join

#: Shingles whose hash is below this are the front of the global order; their frequencies are counted.
FRONT = (5 << 64) // 16
#: Documents in one tree, at most about twice this.
TREE_SETS = 512
#: Elements of a tree's edge that are compared before its bound is tested again.
STEP = 64


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of `size` words, lower-cased in A-Z; the whole text if shorter."""
    words = [] if text is None else text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return mixed(window_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(hashes, size))


def least_overlap(n: int, m: int, percent: int) -> int:
    """Common elements that two sets of n and m need for a similarity of percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """First elements of a set of n, in any global order, of which a similar set shares one."""
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """Ordered sets as paths of a tree whose edges hold runs of elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        keys = [s.astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        #: [sets below, depth, (elements of the edge, children, sets that end here, least and most length, end)]
        self.root = self._node(order, 0)

    def _shared(self, i: int, j: int, depth: int) -> int:
        a, b = self.sets[i], self.sets[j]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def _node(self, order: list[int], depth: int) -> list:
        root = [order, depth, None]
        stack = [root]
        while stack:
            frame = stack.pop()
            members, at, _ = frame
            end = self._shared(members[0], members[-1], at) if len(members) > 1 else len(self.sets[members[0]])
            run = self.sets[members[0]][at:end]
            here = [i for i in members if len(self.sets[i]) == end]
            groups: dict[int, list[int]] = {}
            for i in members:
                if len(self.sets[i]) > end:
                    groups.setdefault(int(self.sets[i][end]), []).append(i)
            children = [[g, end, None] for g in groups.values()]
            sizes = [len(self.sets[i]) for i in members]
            frame[2] = (run, children, here, min(sizes), max(sizes), end)
            stack.extend(children)
        return root

    def similar(self, probe: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Members similar to the probe. Subtrees that cannot reach the needed overlap are left, as are
        those of which skip(member) holds for all."""
        lookup = np.sort(probe)
        n = len(probe)
        stack = [(self.root, 0)]
        while stack:
            (members, at, node), overlap = stack.pop()
            run, children, here, least, most, end = node
            if percent * least > 100 * n or 100 * most < percent * n:
                continue
            if len(members) <= 8 and all(map(skip, members)):
                continue
            need = least_overlap(n, max(least, -(-percent * n // 100)), percent)
            alive = True
            for k in range(0, len(run), STEP):
                part = run[k : k + STEP]
                place = np.searchsorted(lookup, part)
                place[place == n] = n - 1
                overlap += int(np.count_nonzero(lookup[place] == part))
                done = at + k + len(part)
                if overlap + min(n - overlap, most - done) < need:
                    alive = False
                    break
            if not alive:
                continue
            for i in here:
                if not skip(i) and overlap >= least_overlap(n, len(self.sets[i]), percent):
                    yield i
            stack.extend((child, overlap) for child in children)


class Forest:
    """Union-find over the members of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, front, d1, d2): the size of each set, its elements in front, and a digest."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, front, d1, d2 = [], [], [], []
            for text in byte_column(batch, "text"):
                grams = shingles(text, size)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                n.append(len(grams))
                front.append(int(np.searchsorted(grams, np.uint64(FRONT))))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, front, d1, d2))],
                names=["doc_id", "n", "front", "d1", "d2"],
            )

    return docs.mapInArrow(scanned, "doc_id long, n long, front long, d1 long, d2 long")


def postings(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, doc_id): each set's elements in front, and if those are fewer than its prefix the next by
    hash. Of equal sets that one task meets only the first is taken."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            tokens, owners = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_column(batch, "text")):
                grams = shingles(text, size)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                if not len(grams) or digest in seen:
                    continue
                seen.add(digest)
                front = int(np.searchsorted(grams, np.uint64(FRONT)))
                some = grams[: max(front, prefix_length(len(grams), percent))]
                tokens.append(some.view(np.int64))
                owners.append(np.full(len(some), doc, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], names=["token", "doc_id"]
                )

    return docs.mapInArrow(scanned, "token long, doc_id long")


def shared_prefixes(tokens: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id): the elements of each prefix that another set has in front as well.

    The global order: front before rest; in front by frequency, then hash; the
    rest by hash. An element that one set alone has comes first and meets nobody,
    so it is only counted; a set with enough of those has no partner at all.
    """
    held = tokens.select("token", "doc_id", F.count("*").over(Window.partitionBy("token")).alias("df")).where("df > 1")
    # unsigned order of hashes: the front is what a shift by the sign bit leaves below the bound
    behind = (F.col("token") < 0) | (F.col("token") >= F.lit(FRONT))
    listed = held.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(~behind, F.struct("df", "token")))).alias("front_list"),
        F.collect_set(F.when(behind, F.col("token"))).alias("rest_list"),
    )
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    alone = F.col("front") - F.size("front_list")
    room = F.greatest(prefix - alone, F.lit(0)).cast("int")
    return (
        listed.join(sets.select("doc_id", "n", "front"), "doc_id")
        .select("doc_id", F.concat(F.slice("front_list", 1, room)["token"], "rest_list").alias("t"))
        .select("doc_id", F.explode("t").alias("token"))
        .distinct()
    )


def _sets(table: pa.Table, size: int) -> list[np.ndarray]:
    return [shingles(t.as_py(), size) for t in table.column("text").cast(pa.binary())]


def _linked_in(size: int, percent: int):
    """All links inside a unit, as (doc, root) of a spanning forest; core: linked with the leader."""

    def linked(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        sets = _sets(table, size)
        leader = table.column("leader")[0].as_py()
        forest, tree = Forest(len(ids)), PrefixTree(sets)
        first: dict[int, int] = {}
        for i, doc in enumerate(ids):
            forest.join(first.setdefault(doc, i), i)
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] != leader, ids[i])):
            for j in tree.similar(sets[i], percent, lambda j: forest.find(j) == forest.find(i)):
                forest.join(i, j)
        center = forest.find(first[leader]) if leader in first else -1
        roots = [forest.find(i) for i in range(len(ids))]
        return pa.table(
            {
                "leader": table.column("leader"),
                "chunk": table.column("chunk"),
                "doc_id": table.column("doc_id"),
                "root": pa.array([ids[r] for r in roots], pa.int64()),
                "core": pa.array([r == center for r in roots]),
            }
        )

    return linked


def _linked_across(size: int, percent: int):
    """Links between the probes and the members of a unit."""

    def linked(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        sets = _sets(table, size)
        probing, core = table.column("probes").to_pylist(), table.column("core").to_pylist()
        forest = Forest(len(ids) + 1)
        members = [i for i in range(len(ids)) if not probing[i]]
        for i in members:
            if core[i]:
                forest.join(i, len(ids))
        out = []
        if members:
            tree = PrefixTree([sets[i] for i in members])
            for i in range(len(ids)):
                if probing[i]:
                    for j in tree.similar(sets[i], percent, lambda j: forest.find(members[j]) == forest.find(i)):
                        forest.join(i, members[j])
                        out.append((ids[i], ids[members[j]]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable over links, for every row.

    A document's set are its distinct runs of `size` words (white space parts
    words, A-Z lower-cased), or all its words as one run if they are fewer. Two
    documents link when 100 * common >= percent * all shingles of both.

    Method: sets are put in one global order, rare shingles first; similar sets
    share a shingle of their prefixes. Documents that share one meet in the
    group of the least of them. A group is dealt in chunks, each a prefix tree of
    sets in hash order that every member walks, so that sets with a common
    beginning share its overlap and subtrees end where the length left cannot
    reach the bound; pairs already connected are not compared. Members not linked
    with their group's least document meet the other chunks too, so no link
    between different components is lost, and a large group of near copies costs
    one walk each.

    Equal sets are one class with its least id. Null text and texts without
    words have 0 shingles and their own id as component. A null id takes no part
    and has a null component. Rows that repeat an id share a component. Very long
    texts are taken whole; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(described(rows, size), "sets")
    reps = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    belongs = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep"))
    classes = written(
        sets.join(reps, ["d1", "d2"], "left").select("doc_id", "n", belongs.alias("rep")), "classes"
    )

    known = rows.where("doc_id IS NOT NULL")
    meet = Window.partitionBy("token").orderBy("doc_id")
    stars = written(
        shared_prefixes(postings(known, size, percent), sets.where("doc_id IS NOT NULL"), percent)
        .withColumn("leader", F.first("doc_id").over(meet))
        .where("leader < doc_id")
        .select("leader", "doc_id")
        .distinct(),
        "stars",
    )
    sizes = stars.groupBy("leader").agg(F.ceil((F.count("*") + 1) / TREE_SETS).cast("int").alias("chunks"))
    members = written(
        lookup_join(stars, sizes, "leader", F.col("doc_id"))
        .select("leader", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), "doc_id")
        .unionByName(
            sizes.select(
                "leader", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                F.col("leader").alias("doc_id"),
            )
        ),
        "members",
    )
    needed = members.select("doc_id").distinct()
    texts = IdFilter.of(needed, "doc_id").passing(known, "doc_id")
    inside = written(
        members.join(texts, "doc_id")
        .select("leader", "chunk", "doc_id", "text")
        .groupBy("leader", "chunk")
        .applyInArrow(_linked_in(size, percent), "leader long, chunk int, doc_id long, root long, core boolean"),
        "inside",
    )
    links = inside.where("doc_id != root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))

    loose = inside.where("NOT core").join(sizes.where("chunks > 1"), "leader").select("leader", "chunk", "chunks", "doc_id").distinct()
    if not loose.isEmpty():
        blocks = loose.groupBy("leader").agg(F.ceil(F.count("*") / TREE_SETS).cast("int").alias("blocks"))
        probes = (
            loose.join(blocks, "leader")
            .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .where("to != chunk")
            .select(
                "leader", F.col("to").alias("chunk"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"),
                "doc_id", F.lit(True).alias("probes"), F.lit(False).alias("core"),
            )
        )
        targets = inside.join(blocks, "leader").select(
            "leader", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            "doc_id", F.lit(False).alias("probes"), "core",
        ).distinct()
        across = (
            probes.unionByName(targets)
            .join(texts, "doc_id")
            .groupBy("leader", "chunk", "block")
            .applyInArrow(_linked_across(size, percent), "a long, b long")
        )
        links = links.unionByName(written(across, "across"))

    rep = classes.where("rep IS NOT NULL").select("doc_id", "rep").distinct()
    edges = (
        links.distinct()
        .join(rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("x")), "a")
        .join(rep.select(F.col("doc_id").alias("b"), F.col("rep").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    # an id on rows of several classes joins them
    twice = rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a != b")
    several = rep.join(twice.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b")
    found = components(edges.unionByName(several))
    return classes.join(found, classes["rep"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, without those whose group holds a smaller doc_id.

    Of rows that repeat an id one stays, the least by a hash of the text. Rows
    with a null id and rows without words are in no group and stay.
    """
    groups = written(similar_groups(docs, size, percent), "groups").where("doc_id IS NOT NULL")
    later = groups.where("component_id != doc_id").select("doc_id").distinct()
    again = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id")
    )
    some, rest = IdFilter.of(later.unionByName(again), "doc_id").parted(packed, "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text"))
    stay = (
        some.where("doc_id IS NOT NULL")
        .join(later, "doc_id", "left_anti")
        .withColumn("n", F.row_number().over(order))
        .where("n = 1")
    )
    return stay.select("row").unionByName(some.where("doc_id IS NULL").select("row")).unionByName(rest.select("row")).select("row.*")
