"""Event-time rules as window expressions: adjusted times and hybrid watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A delay up to this counts as caught up; so long a silence does, too.
CAUGHT_UP_MS = 10_000


def adjusted_times(df: DataFrame, event_time: str, now: str, order: list[str], keys: list[str] | None = None, caught_up: bool = False, name: str = "adjusted", one_task: bool = False) -> DataFrame:
    """Event times until the stream has caught up, then strictly increasing processing times.

    An event that comes at most 10 s late is the first caught up; it and all later
    ones get ``max(last + 1, now)``. With k events since then and last time L, that
    is k + max(L, max(now_j - j)), a running maximum, so no row waits for another.
    ``keys`` names independent streams; without them one task holds all events, which
    must be asked for by ``one_task``. With ``caught_up`` the stream begins so, at L = 0.
    """
    parts = Window.partitionBy(*_streams(keys, one_task))
    upto = parts.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col(now) - F.col(event_time) <= CAUGHT_UP_MS
    latched = F.lit(True) if caught_up else F.coalesce(F.max(fresh).over(upto), F.lit(False))
    out = df.withColumn("__on", latched)
    out = out.withColumn("__k", F.sum(F.col("__on").cast("bigint")).over(upto))
    best = F.max(F.when(F.col("__on"), F.col(now) - F.col("__k"))).over(upto)
    value = F.col("__k") + (F.greatest(best, F.lit(0)) if caught_up else best)
    return out.withColumn(name, F.when(F.col("__on"), value).otherwise(F.col(event_time))).drop("__on", "__k")


def _streams(keys: list[str] | None, one_task: bool) -> list:
    if not keys and not one_task:
        raise ValueError("without keys all events go to one task: name keys, or say one_task=True")
    return keys or [F.lit(0)]


def observed_delay(df: DataFrame, event_time: str, now: str, name: str = "delay") -> DataFrame:
    """``df``, with the largest and the mean delay of its events reported as metrics.

    Read them from a ``QueryExecutionListener`` or ``StreamingQueryListener``, or by
    ``Observation(name)`` in batch.
    """
    late = F.col(now) - F.col(event_time)
    return df.observe(name, F.max(late).alias("max_delay_ms"), F.avg(late).alias("mean_delay_ms"))


def replayed_watermarks(events: DataFrame, ticks: DataFrame, max_delay_ms: int, allowed_ms: int = 0, start_ms: int = 0, keys: list[str] | None = None, one_task: bool = False) -> DataFrame:
    """The watermark at each tick of a replay.

    ``events`` (seq, clock, event_time) and ``ticks`` (seq, clock) share one order
    ``seq``, and share ``keys`` of independent streams (or all go to ``one_task``); ``clock`` of an event is
    the time at which it is seen. While the stream lags, the watermark trails the
    highest event time by ``max_delay_ms``; once an event came at most 10 s late,
    or 10 s passed without events, by ``allowed_ms``. Running maxima, no loop.
    """
    keys = keys or []
    both = events.select(*keys, "seq", "clock", "event_time").unionByName(ticks.select(*keys, "seq", "clock", F.lit(None).cast("bigint").alias("event_time")))
    upto = Window.partitionBy(*_streams(keys, one_task)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_event = F.col("event_time").isNotNull()
    caught: Column = F.coalesce(F.max(F.when(is_event, F.col("clock") - F.col("event_time") <= CAUGHT_UP_MS)).over(upto), F.lit(False))
    top = F.coalesce(F.max("event_time").over(upto), F.lit(0))
    last = F.coalesce(F.last(F.when(is_event, F.col("clock")), ignorenulls=True).over(upto), F.lit(start_ms))
    quiet = F.col("clock") - last >= CAUGHT_UP_MS
    mark = F.when(caught | quiet, top - allowed_ms).otherwise(top - max_delay_ms)
    return both.select(*keys, "seq", "clock", "event_time", mark.alias("watermark")).where("event_time is null").drop("event_time")
