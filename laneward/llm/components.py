"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneward.llm.common import written


def _order(name: str, turn: int) -> Column:
    """A random order of the nodes, another one each round, ties by the node itself."""
    return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("chance"), F.col(name).alias("node"))


def _moves(left: DataFrame, turn: int) -> DataFrame:
    """(at, to): each node of the edges and where it goes, up to four steps towards a node before all its neighbours."""
    ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = ends.groupBy("a").agg(F.min(_order("b", turn)).alias("first"))
    step = first.select(
        F.col("a").alias("at"),
        F.when(F.col("first") < _order("a", turn), F.col("first")["node"]).otherwise(F.col("a")).alias("to"),
    )
    step = written(step, "steps")
    for _ in range(2):
        further = step.select(F.col("at").alias("to"), F.col("to").alias("next"))
        step = step.join(further, "to").select("at", F.col("next").alias("to"))
    return written(step, "moves")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node reachable.

    Each round orders the nodes by chance; a node moves to its first neighbour, if
    that comes before it, and on from there. Edges between different places are left
    for the next round. Whatever the ids, the nodes left shrink by a constant factor
    on average, so rounds grow with the logarithm of a component (ten for a chain of
    10,000), and all rounds together hold a small multiple of the nodes. The moves are
    composed from the last round back, over tables that double, and each node's place
    is then named by its least node. A hub is one partial aggregate. Rounds are
    written to the shared folder. Edges with a null end and loops say nothing; a loop
    still names its node.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL"
    )
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = pairs.where("a = b").select(F.col("a").alias("at"), F.col("a").alias("to"))
    left, rounds = pairs.where("a != b"), []
    while not left.isEmpty():
        move = _moves(left, len(rounds))
        rounds.append(move)
        to_a = move.select(F.col("at").alias("a"), F.col("to").alias("x"))
        to_b = move.select(F.col("at").alias("b"), F.col("to").alias("y"))
        moved = left.join(to_a, "a").join(to_b, "b").where("x != y")
        left = written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    places = rounds.pop() if rounds else alone
    while rounds:
        later = places.select(F.col("at").alias("to"), F.col("to").alias("last"))
        moved = rounds.pop().join(later, "to", "left").select("at", F.coalesce("last", "to").alias("to"))
        places = written(moved, "places")
    names = places.groupBy("to").agg(F.min("at").alias("component"))
    named = places.join(names, "to").select(F.col("at").alias("node"), "component")
    lone = alone.join(places, "at", "left_anti") if places is not alone else alone.limit(0)
    return named.unionByName(lone.select(F.col("at").alias("node"), F.col("to").alias("component")))
