"""Feature reuse: a lane's request reuses its last computed row for 15 minutes.

The age runs from the computed row (the anchor) and does not slide, so which
requests are anchors depends on the whole earlier chain of the lane. Rows are
placed by range of (lane, time, id). Each bucket is a function from the anchor
carried in to the anchor carried out, and it is a step function: what counts of
the anchor is the first row it no longer covers. The steps of all buckets are a
small table; where each step leads in a later bucket is one as-of lookup among
steps. The steps taken from a lane's first row on are found by doubling: after k
rounds all those within 2**k buckets are known. One last pass over the rows
follows the chains from the anchors carried in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneward.operators.ordered import BUCKET, ordered_buckets, per_bucket
from laneward.session import cut_lineage

TTL_SECONDS = 900


def _follow(rows: pd.DataFrame, ttl_us: int) -> pd.DataFrame:
    """Source of every row of one bucket (rows: lane, at, request_id, in_at, in_id)."""
    rows = rows.sort_values(["lane", "at", "request_id"], kind="stable", ignore_index=True)
    at = rows["at"].to_numpy("int64")
    code = pd.factorize(rows["lane"])[0]
    n = len(rows)
    index = np.arange(n)
    start = np.r_[True, code[1:] != code[:-1]]
    lane = np.cumsum(start) - 1  # a null lane is one like any other
    first = index[start]
    end = np.r_[first[1:], n]

    # position of the first row of the same lane at least ttl later (n: none);
    # times are made increasing over lanes so that one search serves all
    rank = np.unique(np.r_[at, at + ttl_us], return_inverse=True)[1].astype("int64")
    width = rank.max() + 1
    place = lane.astype("int64") * width + rank[:n]
    following = np.searchsorted(place, lane.astype("int64") * width + rank[n:])
    following = np.where(following < end[lane], following, n)

    # the first anchor of each lane, given the anchor carried into the bucket
    carried = rows["in_at"].to_numpy("float64")[first]
    has_carry = ~np.isnan(carried)
    current = first.copy()
    for k in np.flatnonzero(has_carry):
        ready = int(rows["in_at"].iat[first[k]]) + ttl_us
        current[k] = first[k] + np.searchsorted(at[first[k] : end[k]], ready)
    current = current[current < end]

    anchor = np.zeros(n, bool)
    while current.size:  # all lanes of the bucket advance together
        anchor[current] = True
        current = following[current]
        current = current[current < n]

    source = np.maximum.accumulate(np.where(anchor, index, -1))
    here = source >= first[lane]
    ids = rows["request_id"].to_numpy(object)
    rows["source_request_id"] = np.where(here, ids[np.maximum(source, 0)], rows["in_id"].to_numpy(object))
    rows["source_at"] = np.where(here, at[np.maximum(source, 0)], rows["in_at"].fillna(0).to_numpy("int64"))
    rows["is_reuse"] = ~anchor
    return rows


def _steps(rows: pd.DataFrame, ttl_us: int) -> pd.DataFrame:
    """The steps of one lane in one bucket: a carried anchor that ends by `upto` leads to the anchor carried out.

    What ends later than the last step leads through the bucket as it is.
    """
    rows = rows.sort_values(["at", "request_id"], kind="stable", ignore_index=True)
    at = rows["at"].to_numpy("int64")
    following = np.searchsorted(at, at + ttl_us)
    last = np.where(following < len(at), following, np.arange(len(at)))
    while not np.array_equal(last, last[last]):
        last = last[last]
    # a carried anchor is not later than the first row, so it ends within ttl of it
    entry = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    entry = entry[: np.searchsorted(at[entry], at[0] + ttl_us) + 1]
    leave = last[entry]
    kept = np.r_[leave[1:] != leave[:-1], True]
    return pd.DataFrame(
        {
            BUCKET: rows[BUCKET].iat[0],
            "lane": rows["lane"].iat[0],
            "upto": at[entry[kept]],
            "out_at": at[leave[kept]],
            "out_id": rows["request_id"].to_numpy(object)[leave[kept]],
        }
    )


def _carried_in(rows: DataFrame, parts: DataFrame, stored: DataFrame | None, buckets: int, ttl_us: int) -> DataFrame:
    """(_in, _of, in_at, in_id): the anchor that comes into each bucket of a lane over several buckets."""
    schema = rows.schema
    lane, id_ = schema["lane"].dataType.simpleString(), schema["request_id"].dataType.simpleString()
    held = parts.groupBy("lane").agg(F.count("*").alias("n"), F.min(BUCKET).alias("first"))
    # a boundary is crossed by one lane at most
    over = cut_lineage(held.where("n > 1").select(F.col("lane").alias("over"), "first"))
    spanning = rows.join(F.broadcast(over.select("over")), rows["lane"].eqNullSafe(F.col("over")), "left_semi")
    found = per_bucket(spanning, buckets).groupBy(BUCKET, "lane").applyInPandas(
        lambda pdf: _steps(pdf, ttl_us), f"{BUCKET} int, lane {lane}, upto long, out_at long, out_id {id_}"
    )
    steps = cut_lineage(found.withColumn("step", F.monotonically_increasing_id()))

    # where each step leads: the first step that ends at or after the time its anchor lasts to
    begun = over.select(F.col("over").alias("lane"))
    if stored is None:
        begun = begun.select("lane", F.lit(None).cast("long").alias("_at"), F.lit(None).cast(id_).alias("_id"))
    else:
        begun = _with_stored(begun, stored, "left")
    begun = cut_lineage(begun)
    none = F.lit(None).cast("long")
    asked = steps.select("lane", F.col("step").alias("source"), (F.col("out_at") + ttl_us).alias("time")).unionByName(
        begun.select("lane", F.lit(-1).cast("long").alias("source"), F.coalesce(F.col("_at") + ttl_us, F.lit(-(1 << 63))).alias("time"))
    )
    points = steps.select("lane", none.alias("source"), F.col("upto").alias("time"), BUCKET, "step").unionByName(
        asked.withColumns({BUCKET: F.lit(None).cast("int"), "step": none})
    )
    back = Window.partitionBy("lane").orderBy(F.desc("time"), F.desc(F.col("step").isNotNull()), F.desc(BUCKET))
    leads = points.withColumn("next", F.last("step", ignorenulls=True).over(back)).where("source IS NOT NULL AND next IS NOT NULL")
    leads = cut_lineage(leads.select("source", "next"))

    reached = leads.where("source = -1").select(F.col("next").alias("step"))
    jump = leads.where("source >= 0")
    for _ in range((buckets - 1).bit_length()):  # a chain takes each bucket once at most
        further = reached.join(jump, F.col("step") == F.col("source")).select(F.col("next").alias("step"))
        reached = cut_lineage(reached.union(further))
        twice = jump.select(F.col("source").alias("next"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(twice, "next").select("source", F.col("then").alias("next")))

    left = steps.join(reached.distinct(), "step").select(F.col("lane").alias("l"), F.col(BUCKET).alias("b"), "out_at", "out_id")
    cells = parts.join(F.broadcast(over.select("over")), parts["lane"].eqNullSafe(F.col("over")), "left_semi")
    cells = cells.join(left, cells["lane"].eqNullSafe(left["l"]) & (cells[BUCKET] == left["b"]), "left")
    earlier = Window.partitionBy("lane").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    out = F.when(F.col("out_at").isNotNull(), F.struct("out_at", "out_id"))
    cells = cells.select("lane", BUCKET, F.last(out, ignorenulls=True).over(earlier).alias("o"))
    begun = begun.select(F.col("lane").alias("l"), "_at", "_id")
    return cells.join(begun, cells["lane"].eqNullSafe(begun["l"])).select(
        F.col(BUCKET).alias("_in"),
        F.col("lane").alias("_of"),
        F.coalesce("o.out_at", "_at").alias("in_at"),
        F.coalesce("o.out_id", "_id").alias("in_id"),
    )


def _with_stored(rows: DataFrame, stored: DataFrame, how: str) -> DataFrame:
    """Join stored anchors by lane, the null lane too."""
    named = stored.withColumnRenamed("lane", "_stored_lane")
    return rows.join(named, rows["lane"].eqNullSafe(named["_stored_lane"]), how).drop("_stored_lane")


def reuse_features(
    requests: DataFrame,
    ttl_seconds: int = TTL_SECONDS,
    anchors: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """(lane, created_at, request_id, source_request_id, source_at, is_reuse).

    requests: lane, created_at, request_id. ``anchors`` continues an earlier
    run: (lane, source_at, source_request_id), one row per lane. Rows older than
    the anchor of their lane cannot reuse it; they follow one another alone. Rows
    without a lane are a lane of their own.
    """
    if anchors is not None:
        stored = anchors.select("lane", F.col("source_at").alias("_stored_at"))
        marked = _with_stored(requests.select("lane", "created_at", "request_id"), stored, "left")
        is_late = F.coalesce(F.col("created_at").cast("timestamp") < F.col("_stored_at"), F.lit(False))
        marked = cut_lineage(marked.withColumn("_late", is_late))
        late = marked.where("_late").drop("_late", "_stored_at")
        if not late.isEmpty():
            on_time = marked.where("NOT _late").drop("_late", "_stored_at")
            return reuse_features(on_time, ttl_seconds, anchors, buckets).unionByName(
                reuse_features(late, ttl_seconds, None, buckets)
            )
    ttl_us = ttl_seconds * 1_000_000
    id_type = requests.schema["request_id"].dataType
    keyed = requests.select(
        "lane", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "request_id"
    )
    lane_text, id_text = keyed.schema["lane"].dataType.simpleString(), id_type.simpleString()
    rows, buckets = ordered_buckets(keyed, ["lane", "at", "request_id"], buckets)
    stored = None
    if anchors is not None:
        stored = anchors.select(
            "lane",
            F.unix_micros(F.col("source_at").cast("timestamp")).alias("_at"),
            F.col("source_request_id").alias("_id"),
        )
    parts = rows.groupBy("lane", BUCKET).agg(F.lit(1).alias("one"))
    entering = rows
    if buckets > 1:
        # lanes over a boundary: fewer rows than two per bucket
        carried = F.broadcast(_carried_in(rows, parts, stored, buckets, ttl_us))
        same = (entering[BUCKET] == carried["_in"]) & entering["lane"].eqNullSafe(carried["_of"])
        entering = entering.join(carried, same, "left").drop("_in", "_of")
    else:
        entering = entering.withColumns({"in_at": F.lit(None).cast("long"), "in_id": F.lit(None).cast(id_text)})
    if stored is not None:
        # lanes are not bounded: their stored anchors meet the rows by a shuffle join
        first = _with_stored(parts.groupBy("lane").agg(F.min(BUCKET).alias(BUCKET)), stored, "inner")
        first = first.withColumnsRenamed({BUCKET: "_in", "lane": "_of"})
        same = (entering[BUCKET] == first["_in"]) & entering["lane"].eqNullSafe(first["_of"])
        entering = entering.join(first, same, "left").select(
            *rows.columns, F.coalesce("in_at", "_at").alias("in_at"), F.coalesce("in_id", "_id").alias("in_id")
        )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        done = _follow(pdf, ttl_us)
        return done[["lane", "at", "request_id", "source_request_id", "source_at", "is_reuse"]]

    done = per_bucket(entering, buckets).groupBy(BUCKET).applyInPandas(
        follow,
        f"lane {lane_text}, at long, request_id {id_text}, source_request_id {id_text}, source_at long, is_reuse boolean",
    )
    return done.select(
        "lane",
        F.timestamp_micros("at").alias("created_at"),
        "request_id",
        "source_request_id",
        F.timestamp_micros("source_at").alias("source_at"),
        "is_reuse",
    )


def last_anchors(reused: DataFrame) -> DataFrame:
    """The newest anchor of each lane, to continue from in a later run."""
    newest = F.max_by(F.struct("source_at", "source_request_id"), F.struct("source_at", "created_at"))
    return reused.groupBy("lane").agg(newest.alias("_a")).select("lane", "_a.*")
