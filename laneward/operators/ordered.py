"""Running computations over an ordered table without a hot task.

A window partitioned by lane (or by nothing) puts a hot lane into one task. The
operators here place rows by *range* of (keys, order, unique id) instead, so
that every bucket holds about the same number of rows whatever the keys look
like, run the window inside each bucket, and carry a small summary from bucket
to bucket. Because the order starts with the keys, at most one key continues
across each bucket boundary: the carried table has fewer rows than there are
buckets.

The ranges are constants: their bounds are quantiles of a sample that depends on
the rows alone. A row's bucket is so a deterministic expression of the row, the
same wherever it is computed again, and the rows are shuffled once, by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from laneward.session import shuffle_width

BUCKET = "_bucket"
#: Rows meant for one bucket; fewer, but not fewer than FEW_ROWS, if tasks would stand idle.
BUCKET_ROWS, FEW_ROWS = 2_000_000, 100
#: Buckets at most, and keys sampled for each bound. Their product is what the driver sees.
MOST_BUCKETS, SAMPLED = 2048, 16


def _plain(df: DataFrame, name: str) -> Column:
    """A column of the order as a type whose values are plain constants, in the same order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    return F.col(name)


def ordered_buckets(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their bucket, one of consecutive, evenly filled ranges of ``order``, and the number of buckets.

    ``order`` must end in a unique column, so that equal leading values can still
    be split. Rows stay where they are; bounds come from about SAMPLED keys for each
    bucket, chosen by a hash of the key. The bucket count follows the row count.
    """
    keys = [_plain(df, c).alias(f"k{i}") for i, c in enumerate(order)]
    total = df.count()
    width = shuffle_width(df.sparkSession)
    n = buckets or min(MOST_BUCKETS, max(1, -(-total // BUCKET_ROWS), min(width, -(-total // FEW_ROWS))))
    # not a constant, which would turn the later joins on it into nested loops
    alone = F.pmod(F.xxhash64(order[0]), F.lit(1)).cast("int")
    if n == 1 or total == 0:
        return df.withColumn(BUCKET, alone), 1
    rate = min(1.0, 4 * SAMPLED * n / total)
    sample = df.select(*keys)
    chosen = F.xxhash64(*sample.columns) <= F.lit(min((1 << 63) - 1, int(rate * (1 << 64)) - (1 << 63)))
    some = sample.where(chosen).orderBy(*sample.columns).collect()  # 4 * SAMPLED * n rows are expected
    cuts = [some[len(some) * k // n] for k in range(1, n)] if some else []
    if not cuts:
        return df.withColumn(BUCKET, alone), 1
    kinds = [sample.schema[c].dataType for c in sample.columns]
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t) for v, t in zip(row, kinds)]) for row in cuts])
    key = F.struct(*keys)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at),
    )
    return df.withColumn(BUCKET, found), n


def per_bucket(placed: DataFrame, buckets: int) -> DataFrame:
    """One task per bucket, for windows and grouped maps on the bucket: the one shuffle of the rows.

    Summaries of the buckets do not need it: they add up rows where they lie and
    shuffle one row per key and bucket.
    """
    return placed.repartitionById(buckets, F.col(BUCKET))


def bucket_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of one key in one bucket, from the first up to the current one."""
    return (
        Window.partitionBy(BUCKET, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _carried(rows: DataFrame, keys: Sequence[str], summary: dict[str, Column], carry: dict) -> DataFrame:
    """One row per (key, bucket) that continues a key from an earlier bucket."""
    per_bucket = rows.groupBy(BUCKET, *keys).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.count(F.lit(1)).over(earlier)
    carried = per_bucket.select(
        BUCKET, *keys, seen.alias("_seen"), *[make(earlier).alias(n) for n, make in carry.items()]
    )
    return carried.where("_seen > 0").drop("_seen")


def with_carried(local: DataFrame, carried: DataFrame, keys: Sequence[str], bounded: bool = True) -> DataFrame:
    """Left join of what is carried into each bucket; a null key continues like any other.

    Fewer rows than buckets (module text) are always small enough to broadcast;
    ``bounded`` says whether there are no others.
    """
    named = carried.select(*[F.col(k).alias(f"_of_{i}") if k in (BUCKET, *keys) else F.col(k) for i, k in enumerate(carried.columns)])
    names = dict(zip(carried.columns, named.columns))
    same = local[BUCKET] == named[names[BUCKET]]
    for k in keys:
        same &= local[k].eqNullSafe(named[names[k]])
    joined = local.join(F.broadcast(named) if bounded else named, same, "left")
    return joined.drop(*[names[k] for k in (BUCKET, *keys)])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Replace each column of ``sums`` by its running total per key."""
    rows, buckets = ordered_buckets(df, [*keys, *order], buckets)
    carried = _carried(
        rows,
        keys,
        {f"_{c}": F.sum(c) for c in sums},
        {f"_{c}": (lambda w, c=c: F.sum(f"_{c}").over(w)) for c in sums},
    )
    window = bucket_window(keys, order)
    local = per_bucket(rows, buckets).select(
        *[c for c in rows.columns if c not in sums], *[F.sum(c).over(window).alias(c) for c in sums]
    )
    total = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums}
    return (
        with_carried(local, carried, keys)
        .withColumns(total)
        .drop(BUCKET, *[f"_{c}" for c in sums])
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    buckets: int | None = None,
) -> DataFrame:
    """Fill ``column`` with the newest non-null value at or before each row."""
    rows, buckets = ordered_buckets(df, [*keys, *order], buckets)
    place = F.when(F.col(column).isNotNull(), F.struct(*order))
    carried = _carried(
        rows,
        keys,
        {"_last": F.max_by(column, place)},
        {"_last": lambda w: F.last("_last", ignorenulls=True).over(w)},
    )
    window = bucket_window(keys, order)
    local = per_bucket(rows, buckets).withColumn(column, F.last(column, ignorenulls=True).over(window))
    filled = F.coalesce(column, "_last")
    return with_carried(local, carried, keys).withColumn(column, filled).drop(BUCKET, "_last")
