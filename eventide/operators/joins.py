"""Joins in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.monoid import LATEST
from eventide.operators.running import _running_split
from eventide.schema import SEQ, TS

SIDE = "__side"


def _union(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str]) -> DataFrame:
    """Both sides' events in one table; a side's values are null where none is present."""

    def tagged(df: DataFrame, side: int, own: list[str], name: str, other: DataFrame, values: list[str], blank: str) -> DataFrame:
        kind = other.select(F.struct(*values)).schema[0].dataType
        return df.select(TS, *keys, F.lit(side).alias(SIDE), SEQ, F.struct(*own).alias(name), F.lit(None).cast(kind).alias(blank))

    events = tagged(left, 1, left_values, "l", right, right_values, "r").unionByName(tagged(right, 0, right_values, "r", left, left_values, "l"))
    return events.withColumns({"r": F.when(_any([f"r.{v}" for v in right_values]), F.col("r")), "l": F.when(_any([f"l.{v}" for v in left_values]), F.col("l"))})


def point_in_time_left(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], split_ms: int | None = None) -> DataFrame:
    """(ts, seq, keys, l, r): each left event with the latest right event of its key at or before its time.

    Structs ``l`` and ``r`` hold the values; r is null where there is none. Right
    events come before left ones of the same time. Left events with all values null
    are dropped, right events with all values null are no update. Both sides go
    through one exchange and one sort; with ``split_ms`` a key's events are dealt
    out by time as well, so one key cannot hold up a task.
    """
    events = _union(left, right, keys, left_values, right_values)
    if split_ms is None:
        window = Window.partitionBy(*keys).orderBy(TS, SIDE, SEQ).rowsBetween(Window.unboundedPreceding, 0)
        joined = events.withColumn("r", F.last("r", ignorenulls=True).over(window))
    else:
        found = _running_split(events, keys, {"__r": (LATEST, F.col("r"))}, [SIDE], split_ms)
        joined = found.withColumn("r", F.col("__r")).drop("__r")
    return joined.where((F.col(SIDE) == 1) & F.col("l").isNotNull()).select(TS, SEQ, *keys, "l", "r")


def _any(values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.col(v).isNotNull()
    return out


def debounced_left(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], latency_ms: int) -> DataFrame:
    """The pair of latest values, emitted once a key has been quiet for ``latency_ms``.

    Every event of either side puts off the key's timer to ts + latency + 1; when
    it fires, at that time, the latest left and right values are emitted, provided
    there is a left one. The batch form sees all events in order, so an event is
    followed by an emission if the key's next event comes after its timer.
    """
    if latency_ms < 0:
        raise ValueError("latency must not be negative")
    events = _union(left, right, keys, left_values, right_values)
    order = Window.partitionBy(*keys).orderBy(TS, SIDE, SEQ)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select("*", F.last("l", ignorenulls=True).over(so_far).alias("__l"), F.last("r", ignorenulls=True).over(so_far).alias("__r"), F.lead(TS).over(order).alias("__next"))
    quiet = F.col("__next").isNull() | (F.col("__next") > F.col(TS) + latency_ms)
    return seen.where(quiet & F.col("__l").isNotNull()).select((F.col(TS) + latency_ms + 1).alias(TS), SEQ, *keys, F.col("__l").alias("l"), F.col("__r").alias("r"))
