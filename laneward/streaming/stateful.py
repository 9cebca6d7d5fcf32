"""Streams whose state spans all earlier rows: normaliser and reuse.

Each micro-batch runs the batch operator, continued from a saved state version,
so a batch is as parallel as a table and a hot key is split as it is there. The
state version and the output folder are named by the batch id: a batch that is
replayed after a failure reads the version before its own and overwrites what
its first attempt wrote, so that no row is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from laneward.operators.normalize import REQUEST_ORDER, normalize_running
from laneward.operators.reuse import TTL_SECONDS, last_anchors, reuse_features
from laneward.operators.stats import feature_stats, merge_stats
from laneward.sources.state import load_state, save_state

BatchStep = Callable[[DataFrame, int], None]


def _write_batch(out: DataFrame, path: str, batch_id: int) -> None:
    out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def normalize_step(
    features: Sequence[str], state_path: str, out_path: str, order: Sequence[str] = REQUEST_ORDER
) -> BatchStep:
    """The micro-batch function of ``normalize_stream``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        rows = batch.persist()
        try:
            state = load_state(batch.sparkSession, state_path, before=version)
            _write_batch(normalize_running(rows, features, order, state=state), out_path, batch_id)
            seen = feature_stats(rows, features)
            save_state(seen if state is None else merge_stats(state, seen), state_path, version)
        finally:
            rows.unpersist()

    return step


def normalize_stream(
    raw: DataFrame, features: Sequence[str], state_path: str, out_path: str, order: Sequence[str] = REQUEST_ORDER
) -> DataStreamWriter:
    """Normalise a stream of wide feature rows against all rows before them.

    Equal to the batch form when batches arrive in order. Set the trigger and
    the checkpoint location on the result and start it.
    """
    return raw.writeStream.foreachBatch(normalize_step(features, state_path, out_path, order))


def reuse_step(
    state_path: str, out_path: str, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 day"
) -> BatchStep:
    """The micro-batch function of ``reuse_stream``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        spark = batch.sparkSession
        known = load_state(spark, state_path, before=version)
        _write_batch(reuse_features(batch, ttl_seconds, anchors=known), out_path, batch_id)
        newest = last_anchors(spark.read.parquet(f"{out_path}/batch={batch_id}"))
        if known is not None:
            pick = F.max_by(F.struct("source_at", "source_request_id"), "source_at")
            both = known.unionByName(newest).groupBy("lane").agg(pick.alias("a"))
            newest = both.select("lane", "a.*")
        # an anchor this old can no longer be reused by any row that is not late
        last = spark.read.parquet(f"{out_path}/batch={batch_id}").agg(F.max("created_at")).first()[0]
        horizon = F.lit(last) - F.expr(f"interval {lateness}") - F.make_interval(secs=F.lit(ttl_seconds))
        kept = newest if last is None else newest.where(F.col("source_at") > horizon)
        save_state(kept, state_path, version)

    return step


def reuse_stream(
    requests: DataFrame, state_path: str, out_path: str, ttl_seconds: int = TTL_SECONDS, lateness: str = "1 day"
) -> DataStreamWriter:
    """At most one computed row per lane and 15 minutes, over a stream of requests.

    Writes (lane, created_at, request_id, source_request_id, source_at, is_reuse).
    """
    return requests.writeStream.foreachBatch(reuse_step(state_path, out_path, ttl_seconds, lateness))
