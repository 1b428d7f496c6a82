"""Trailing event-time windows: for every event, its key's events in [ts - size, ts]."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.schema import SEQ, TS


@dataclass(frozen=True)
class TrailingWindow:
    """``size`` and ``slide`` in milliseconds. Batch results do not depend on ``slide``; streams keep
    ``size`` + 14 slides of events for late ones."""

    size: int
    slide: int = 1

    def __post_init__(self) -> None:
        if self.size < 0 or self.slide <= 0:
            raise ValueError("size must not be negative and slide must be positive")

    @property
    def kept(self) -> int:
        return self.size + 14 * self.slide


def _checked(window: object) -> TrailingWindow:
    if not isinstance(window, TrailingWindow):
        raise ValueError(f"{type(window).__name__} is no trailing window; others are not supported")
    return window


def trailing(df: DataFrame, keys: list[str], window: TrailingWindow, aggregates: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over the window; all events of the same time see each other."""
    frame = Window.partitionBy(*keys).orderBy(TS).rangeBetween(-_checked(window).size, 0)
    return df.withColumns({n: a.over(frame) for n, a in aggregates.items()})


def trailing_distinct(df: DataFrame, keys: list[str], window: TrailingWindow, value: Column, name: str) -> DataFrame:
    """Exact number of distinct non-null values in the window."""
    return trailing(df, keys, window, {}).withColumn(name, F.size(F.collect_set(value).over(Window.partitionBy(*keys).orderBy(TS).rangeBetween(-window.size, 0))))


def trailing_in_arrival(df: DataFrame, keys: list[str], window: TrailingWindow, sums: dict[str, tuple[str, Column]], order: list[str | Column] | None = None) -> DataFrame:
    """Sums and counts over the window in which later arrivals of the same time are not yet visible.

    The frame has a RANGE start and a ROWS end, which Spark lacks; sums and counts
    can be undone, so the later arrivals' part is taken off the RANGE frame's value.
    ``sums`` maps a name to ("sum" or "count", value). ``order`` goes before arrival
    among events of one time.
    """
    frame = Window.partitionBy(*keys).orderBy(TS).rangeBetween(-_checked(window).size, 0)
    later = Window.partitionBy(*keys, TS).orderBy(*(order or []), SEQ).rowsBetween(1, Window.unboundedFollowing)
    made = {}
    for name, (kind, value) in sums.items():
        if kind not in ("sum", "count"):
            raise ValueError(f"{kind} cannot be undone; use trailing_fold")
        if kind == "count":
            made[name] = F.count(value).over(frame) - F.count(value).over(later)
        else:
            n = F.count(value).over(frame) - F.count(value).over(later)
            made[name] = F.when(n > 0, F.sum(value).over(frame) - F.coalesce(F.sum(value).over(later), F.lit(0)))
    return df.withColumns(made)


def trailing_python(df: DataFrame, keys: list[str], window: TrailingWindow, value: str, function: Callable[[pd.Series], Any], name: str, result_type: str) -> DataFrame:
    """A Python aggregate of the window's values (a pandas Series), through Arrow; equal times see each other.

    For aggregates that no Column can say. Spark sends a key's whole partition to
    Python, with each frame's bounds, so a key's events must fit in a worker's memory.
    """

    def call(values: pd.Series) -> Any:
        return function(values)

    call.__annotations__ = {"values": pd.Series, "return": object}
    frame = Window.partitionBy(*keys).orderBy(TS).rangeBetween(-_checked(window).size, 0)
    return df.withColumn(name, F.pandas_udf(call, result_type)(value).over(frame))


def trailing_fold(df: DataFrame, keys: list[str], window: TrailingWindow, value: Column, body: Callable[[Column], Column], name: str, order: list[str] | None = None) -> DataFrame:
    """Any function of the list of values visible at each event, in the order of time, then ``order``, then arrival.

    ``body`` gets an array of structs (ts, v) from the oldest to the present event.
    The array holds the window's events and those of the same time, no more of the key.
    A null result drops the event.
    """
    frame = Window.partitionBy(*keys).orderBy(TS).rangeBetween(-_checked(window).size, 0)
    place = F.struct(F.col(TS).alias("ts"), *[F.col(c).alias(f"o{i}") for i, c in enumerate([*(order or []), SEQ])])
    listed = df.withColumn("__at", place).withColumn("__v", value)
    listed = listed.withColumn("__seen", F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__v").alias("v"))).over(frame))
    # places are distinct within a key, so values are never compared
    by_place = F.array_sort("__seen", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    seen = F.transform(F.filter(by_place, lambda x: x["at"] <= F.col("__at")), lambda x: F.struct(x["at"]["ts"].alias("ts"), x["v"].alias("v")))
    return listed.withColumn(name, body(seen)).drop("__seen", "__at", "__v").where(F.col(name).isNotNull())
