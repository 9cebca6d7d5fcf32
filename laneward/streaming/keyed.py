"""Streams with one state for each key, in exact order of event time: reuse and the normaliser of a lane.

Rows wait in the state of their key, in slices of event time. Once the watermark
has passed the end of a slice it closes: its rows are worked in order, with what
the key carries from slice to slice. So rows may come in any order within the
lateness, and the result is that of the batch form. A row whose slice has closed
is late: it takes no part and comes out with ``is_late``.

A task holds the rows of one key and one slice, and of one Arrow batch, never all
rows of a key. Timers fire for slices that close, so keys without rows cost
nothing; what a key carries goes when no row in time can use it.

Where one key holds a large share of a stream of small slices, ``stateful.py``
spreads the rows of that key over tasks; here they pass one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from laneward.functions.risk import MIN_VARIANCE, NEUTRAL
from laneward.operators.normalize import REQUEST_ORDER
from laneward.operators.reuse import TTL_SECONDS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sliced(StatefulProcessor):
    """Holds rows (``at`` in microseconds and further columns) until their slice of event time closes.

    Subclasses say what is carried (``carry``), how the rows of a slice are worked
    (``work``), and until when the carried value is of use (``useful_until``).
    """

    carry: str

    def __init__(self, keys: Sequence[str], held: dict[str, str], ties: Sequence[str], slice_seconds: int):
        self.keys, self.held, self.ties = list(keys), held, list(ties)
        self.slice_us = slice_seconds * 1_000_000

    def work(self, rows: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def useful_until(self, carried: tuple) -> int | None:
        """Microseconds from which no row can use the carried value; None: always of use."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"`{c}` array<{t}>" for c, t in self.held.items())
        self.waiting = handle.getMapState("waiting", "slice long", fields)
        self.carried = handle.getValueState("carried", self.carry)

    def _ends(self, at: np.ndarray) -> np.ndarray:
        return (at // self.slice_us + 1) * self.slice_us

    def _timer(self, end_us: int) -> None:
        self.handle.registerTimer(-(-end_us // 1000))

    def _out(self, key: tuple, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        for name, value in zip(self.keys, key):
            rows[name] = pd.Series([value] * len(rows), rows.index, object) if value is None else value
        return rows.assign(is_late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for chunk in rows:
            chunk = chunk[list(self.held)]
            ends = self._ends(chunk["at"].to_numpy("int64"))
            late = ends <= now
            if late.any():
                yield self._out(key, self.late(chunk[late].reset_index(drop=True)), True)
            for end, part in chunk[~late].groupby(ends[~late]):
                place = (int(end) // self.slice_us,)
                columns = [_plain(part[c]) for c in self.held]
                if self.waiting.containsKey(place):
                    columns = [list(old) + new for old, new in zip(self.waiting.getValue(place), columns)]
                else:
                    self._timer(int(end))
                self.waiting.updateValue(place, tuple(columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # all slices that have closed, in order, whichever timer fires first
        closed = sorted(k[0] for k in self.waiting.keys() if k[0] * self.slice_us <= now)
        carried = tuple(self.carried.get()) if self.carried.exists() else None
        for place in closed:
            rows = pd.DataFrame(dict(zip(self.held, map(list, self.waiting.getValue((place,))))))
            rows = rows.sort_values(["at", *self.ties], kind="stable", ignore_index=True)
            done, carried = self.work(rows, carried)
            self.waiting.removeKey((place,))
            yield self._out(key, done, False)
        if carried is None:
            return
        until = self.useful_until(carried)
        if until is not None:
            # a row in time lies in an open slice; the value goes with the last slice it reaches into
            until = int(self._ends(np.int64(until - 1)))
            if until <= now:
                self.carried.clear()
                return
            self._timer(until)
        if closed:
            self.carried.update(carried)


def _plain(column: pd.Series) -> list:
    """Values as plain Python ones; missing ones as None."""
    return [None if pd.isna(v) else v for v in column.tolist()]


class _Reuse(_Sliced):
    def __init__(self, id_type: str, ttl_seconds: int, slice_seconds: int):
        super().__init__(["lane"], {"at": "bigint", "request_id": id_type}, ["request_id"], slice_seconds)
        self.ttl_us = ttl_seconds * 1_000_000
        self.carry = f"at bigint, id {id_type}"

    def work(self, rows, carried):
        at, ids = rows["at"].to_numpy("int64"), rows["request_id"].to_numpy(object)
        source_at, source = np.empty(len(at), np.int64), np.empty(len(at), object)
        anchor = np.zeros(len(at), bool)
        here = 0
        while here < len(at):
            if carried is None or at[here] >= carried[0] + self.ttl_us:
                carried, anchor[here] = (int(at[here]), ids[here]), True
            end = int(np.searchsorted(at, carried[0] + self.ttl_us))
            source_at[here:end], source[here:end] = carried[0], carried[1]
            here = end
        done = rows.assign(source_request_id=source, source_at=source_at, is_reuse=~anchor)
        return done, carried

    def late(self, rows):
        none = pd.Series([None] * len(rows), dtype=object)
        return rows.assign(source_request_id=none, source_at=pd.Series(pd.NA, rows.index, "Int64"), is_reuse=False)

    def useful_until(self, carried):
        return carried[0] + self.ttl_us


class _Normalise(_Sliced):
    carry = "n array<double>, mean array<double>, m2 array<double>"

    def __init__(self, keys: Sequence[str], held: dict[str, str], features: Sequence[str], ties: Sequence[str], slice_seconds: int):
        super().__init__(keys, held, ties, slice_seconds)
        self.features = list(features)

    def work(self, rows, carried):
        n, mean, m2 = (list(part) for part in carried) if carried else ([0.0] * len(self.features) for _ in range(3))
        done = rows.copy()
        for k, feature in enumerate(self.features):
            value = rows[feature].to_numpy("float64")
            known = ~np.isnan(value)
            x = value[known]
            if not len(x):
                continue
            base = mean[k] if n[k] else x[0]
            # deviations from the mean before: those of the earlier rows sum to zero
            off = x - base
            count = n[k] + np.arange(1, len(x) + 1)
            total = np.cumsum(off)
            means = base + total / count
            m2s = m2[k] + np.maximum(np.cumsum(off * off) - total * total / count, 0.0)
            spread = np.sqrt(np.maximum(m2s / np.maximum(count - 1, 1.0), MIN_VARIANCE))
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-(x - means) / spread))
            value[known] = np.where(count < 2, NEUTRAL, score)
            done[feature] = value
            n[k], mean[k], m2[k] = float(count[-1]), float(means[-1]), float(m2s[-1])
        return done, (n, mean, m2)

    def late(self, rows):
        return rows.assign(**{f: np.nan for f in self.features})


def _seconds(interval: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError(f"not a number of seconds, minutes, hours or days: {interval!r}")
    return int(found[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[found[2]]


def _watched(rows: DataFrame, time: str, lateness: str) -> DataFrame:
    """The rows with ``at`` in microseconds; the watermark follows their time.

    The time column itself goes, so that late rows reach the processor, which
    gives them out, and are not dropped before.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    timed = rows.withColumn("_time", F.col(time).cast("timestamp")).where("_time IS NOT NULL")
    return timed.withWatermark("_time", lateness).withColumn("at", F.unix_micros("_time")).drop("_time", time)


def reuse_lane_stream(
    requests: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "15 minutes", slice_of: str = "15 minutes"
) -> DataFrame:
    """(lane, created_at, request_id, source_request_id, source_at, is_reuse, is_late), in append mode.

    requests: lane, created_at, request_id. Equal to ``reuse_features`` over the rows
    in time, in whatever order they come within ``lateness``; a row comes out when the
    watermark has passed its slice. Late rows come out at once, with no source, and no
    row reuses them. Rows without a time are left out.
    """
    lane, id_ = (requests.schema[c].dataType.simpleString() for c in ("lane", "request_id"))
    rows = _watched(requests.select("lane", "created_at", "request_id"), "created_at", lateness)
    out = rows.groupBy("lane").transformWithStateInPandas(
        _Reuse(id_, ttl_seconds, _seconds(slice_of)),
        f"lane {lane}, at bigint, request_id {id_}, source_request_id {id_}, source_at bigint, is_reuse boolean, is_late boolean",
        "Append",
        "EventTime",
    )
    return out.select(
        "lane",
        F.timestamp_micros("at").alias("created_at"),
        "request_id",
        "source_request_id",
        F.timestamp_micros("source_at").alias("source_at"),
        "is_reuse",
        "is_late",
    )


def normalize_lane_stream(
    raw: DataFrame,
    features: Sequence[str],
    scope: Sequence[str] = ("lane",),
    order: Sequence[str] = REQUEST_ORDER,
    lateness: str = "1 day",
    slice_of: str = "1 day",
) -> DataFrame:
    """(scope, order, features, is_late): each feature normalised against the rows before it of its scope.

    Equal to ``normalize_running(scope=...)`` over the rows in time, in whatever order
    they come within ``lateness``. ``order`` is a time column and ties after it. Null
    and NaN features are neither counted nor scored; those of late rows come out null.
    Rows without a time are left out.
    """
    time, ties = order[0], list(order[1:])
    kinds = {f.name: f.dataType.simpleString() for f in raw.schema.fields}
    held = {"at": "bigint", **{c: kinds[c] for c in ties}, **{f: "double" for f in features}}
    wanted = [*scope, time, *ties, *[F.col(f).cast("double").alias(f) for f in features]]
    rows = _watched(raw.select(*wanted), time, lateness)
    fields = {**{c: kinds[c] for c in scope}, **held}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items()) + ", is_late boolean"
    out = rows.groupBy(*scope).transformWithStateInPandas(
        _Normalise(scope, held, features, ties, _seconds(slice_of)), schema, "Append", "EventTime"
    )
    return out.select(
        *scope,
        F.timestamp_micros("at").alias(time),
        *ties,
        *[F.nanvl(f, F.lit(None).cast("double")).alias(f) for f in features],
        "is_late",
    )
