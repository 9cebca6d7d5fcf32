"""Running normaliser: each row against the history up to and including it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneward.functions.risk import squash
from laneward.operators.ordered import BUCKET, bucket_window, ordered_buckets, per_bucket, with_carried
from laneward.operators.stats import stats_long

REQUEST_ORDER = ("created_at", "request_id")


def _history(totals: DataFrame, groups: list[str], features: Sequence[str]) -> DataFrame:
    """For each bucket, the merged statistics of all buckets before it.

    Merging bucket k with mean m into (N, mu) adds
    n * (m - mu_before) * (m - mu_after) to M2, which is never negative; the
    means are summed around the first one. Both keep the merge stable when the
    mean is large beside the spread.
    """
    keys = [*groups, "feature"]
    ordered = Window.partitionBy(*keys).orderBy(BUCKET)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.first("mean").over(upto)
    count = F.col("count")
    merged = (
        totals.withColumn("_base", base)
        .withColumn("_n", F.sum("count").over(upto))
        .withColumn(
            "_mu",
            F.col("_base") + F.sum(count * (F.col("mean") - F.col("_base"))).over(upto) / F.col("_n"),
        )
        .withColumn("_mu_before", F.lag("_mu").over(ordered))
        .withColumn(
            "_m2",
            F.sum(
                F.col("M2")
                + F.coalesce(
                    count * (F.col("mean") - F.col("_mu_before")) * (F.col("mean") - F.col("_mu")),
                    F.lit(0.0),
                )
            ).over(upto),
        )
    )
    before = F.struct(
        F.lag("_n").over(ordered).alias("n"),
        F.lag("_mu").over(ordered).alias("mean"),
        F.lag("_m2").over(ordered).alias("m2"),
    )
    return (
        merged.select(BUCKET, *groups, "feature", before.alias("before"))
        .where(F.col("before.n").isNotNull())
        .groupBy(BUCKET, *groups)
        .agg(*[F.max(F.when(F.col("feature") == f, F.col("before"))).alias(f"_before_{f}") for f in features])
    )


def _upto(feature: str) -> Column:
    """(n, mean, m2) of all rows up to this one: the bucket's rows merged with those before."""
    here = F.col(f"_at_{feature}")
    before = F.col(f"_before_{feature}")
    n0 = F.coalesce(before["n"], F.lit(0.0))
    mean0 = F.coalesce(before["mean"], here["mean"])
    m20 = F.coalesce(before["m2"], F.lit(0.0))
    n = n0 + here["n"]
    delta = here["mean"] - mean0
    mean = mean0 + F.try_divide(delta * here["n"], n)
    m2 = m20 + here["m2"] + F.try_divide(delta * delta * n0 * here["n"], n)
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def _normalised(feature: str) -> Column:
    stats = F.col(f"_at_{feature}")
    return squash(F.col(feature), stats["n"], stats["mean"], stats["m2"])


def normalize_running(
    raw: DataFrame,
    features: Sequence[str],
    order: Sequence[str] = REQUEST_ORDER,
    scope: Sequence[str] = (),
    state: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Replace each feature column by its normalised value in (0, 1).

    Row i is scored with the count, mean and variance of rows 1..i (itself
    included) in ``order``, over all rows or within each ``scope``. ``state``
    holds (scope, feature, count, mean, M2) rows of an earlier run to continue
    from. Null values are neither counted nor scored.
    """
    scope = list(scope)
    rows, buckets = ordered_buckets(raw, [*scope, *order], buckets)
    totals = stats_long(rows, [BUCKET, *scope], features)
    if state is not None:
        totals = totals.unionByName(state.withColumn(BUCKET, F.lit(-1)))
    history = _history(totals, scope, features).where(f"{BUCKET} >= 0")

    window = bucket_window(scope, order)
    running = {
        f"_at_{f}": F.struct(
            F.count(f).over(window).cast("double").alias("n"),
            F.avg(f).over(window).alias("mean"),
            (F.var_pop(f).over(window) * F.count(f).over(window)).alias("m2"),
        )
        for f in features
    }
    local = per_bucket(rows, buckets).withColumns(running)
    # at most one continuing scope per bucket; with a state a row per scope, joined by shuffle
    joined = with_carried(local, history, scope, bounded=not scope or state is None)
    merged = joined.withColumns({f"_at_{f}": _upto(f) for f in features})
    return merged.select(
        *[_normalised(c).alias(c) if c in features else F.col(c) for c in raw.columns]
    )
