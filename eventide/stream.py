"""Lazy streams of events: the API that pipelines are written in."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.operators import joins, running, windows
from eventide.operators.monoid import COUNT, MAX, MIN, SUM, Monoid
from eventide.operators.windows import TrailingWindow
from eventide.schema import SEQ, TS, interval, payload


#: A session setting: the folder below which every operator's rows are dumped as JSON when it is built (batch only).
DEBUG_DIR = "eventide.debug.dir"
_steps = itertools.count()


def dumped(df: DataFrame) -> DataFrame:
    """``df``, its rows dumped under the name of the operator that made it if DEBUG_DIR is set."""
    folder = df.sparkSession.conf.get(DEBUG_DIR, None)
    if folder and not df.isStreaming:
        frame = sys._getframe(2)
        while frame.f_code.co_name in ("_with", "__init__"):
            frame = frame.f_back
        df.write.json(f"{folder.rstrip('/')}/{next(_steps):05d}-{frame.f_code.co_name}")
    return df


class EventStream:
    """Events: a DataFrame with ``ts__`` (epoch ms), ``seq__`` (order among equal times) and payload columns.

    Immutable and lazy. The same object may be used many times; Spark reuses
    common exchanges.
    """

    def __init__(self, df: DataFrame):
        for name in (TS, SEQ):
            if name not in df.columns:
                raise ValueError(f"an event stream needs the column {name}")
        self.df = dumped(df)

    @property
    def columns(self) -> list[str]:
        return payload(self.df)

    @property
    def schema(self) -> StructType:
        return self.df.select(*self.columns).schema

    @property
    def is_streaming(self) -> bool:
        return self.df.isStreaming

    def map(self, *columns: Column | str) -> EventStream:
        """One event for each, with these payload columns."""
        return EventStream(self.df.select(TS, SEQ, *columns))

    def flat_map(self, array: Column, name: str, *keep: Column | str) -> EventStream:
        """One event for each element of ``array`` (none for an empty or null one), its time copied."""
        return EventStream(self.df.select(TS, SEQ, *keep, F.explode(array).alias(name)))

    def map_arrow(self, function: Callable, schema: str | StructType) -> EventStream:
        """A Python function over Arrow batches, for what no Column can say; it must pass ts__ and seq__ on."""
        return EventStream(self.df.mapInArrow(function, schema))

    def filter(self, condition: Column) -> EventStream:
        """Events for which the condition is true; null is not."""
        return EventStream(self.df.where(condition))

    def between(self, start: str, end: str) -> EventStream:
        """Events from ``start`` up to but not including ``end`` (ISO-8601)."""
        low, high = interval(start, end)
        return EventStream(self.df.where((F.col(TS) >= low) & (F.col(TS) < high)))

    def union(self, other: EventStream) -> EventStream:
        """All events of both, repeats kept; columns are matched by name."""
        return EventStream(self.df.unionByName(other.df))

    def key_by(self, *keys: str | Column) -> KeyedStream:
        """The stream keyed by columns, or by named expressions, which become columns. No shuffle yet."""
        named = [F.col(k) if isinstance(k, str) else k for k in keys]
        names = self.df.select(*named).columns
        fresh = [k for k, n in zip(named, names) if n not in self.df.columns]
        return KeyedStream(self.df.select("*", *fresh) if fresh else self.df, names)

    def sql(self, query: str, table: str, schema: str | StructType | None = None, approximate_distinct: bool = False) -> EventStream:
        """Spark SQL over this stream as ``table``; see ``eventide.plans.sqlnode``."""
        from eventide.plans.sqlnode import run_sql

        return EventStream(run_sql(self.df, query, table, schema, approximate_distinct))


class KeyedStream:
    """A stream whose events belong to keys; operators work within a key, in event order."""

    def __init__(self, df: DataFrame, keys: list[str], values: list[str] | None = None):
        self.df, self.keys = dumped(df), keys
        self.value_columns = values if values is not None else [c for c in payload(df) if c not in keys]

    def _with(self, df: DataFrame, values: list[str]) -> KeyedStream:
        return KeyedStream(df.select(TS, SEQ, *self.keys, *values), self.keys, values)

    def values(self) -> EventStream:
        """The stream without its keys."""
        return EventStream(self.df.select(TS, SEQ, *self.value_columns))

    def events(self) -> EventStream:
        """The stream with its keys as ordinary columns."""
        return EventStream(self.df.select(TS, SEQ, *self.keys, *self.value_columns))

    def map_value(self, *columns: Column | str) -> KeyedStream:
        """New value columns; key and keying stay."""
        mapped = self.df.select(TS, SEQ, *self.keys, *columns)
        return KeyedStream(mapped, self.keys, mapped.columns[2 + len(self.keys) :])

    def filter(self, condition: Column) -> KeyedStream:
        return KeyedStream(self.df.where(condition), self.keys, self.value_columns)

    def running(self, split_ms: int | None = None, order: list[str | Column] | None = None, **folds: tuple[Monoid, Column]) -> KeyedStream:
        """Running folds ``name=(monoid, value)``: one event for each, the folds beside the values."""
        return self._with(running.running(self.df, self.keys, folds, order, split_ms), [*self.value_columns, *folds])

    def sum(self, value: Column | str, name: str, monoid: Monoid = SUM) -> KeyedStream:
        """The running fold of one value."""
        return self.running(**{name: (monoid, F.col(value) if isinstance(value, str) else value)})

    def ordered_sum(self, value: Column | str, name: str, *order: Column | str, monoid: Monoid = SUM) -> KeyedStream:
        """The running fold with events of equal time put in ``order``."""
        return self.running(order=list(order), **{name: (monoid, F.col(value) if isinstance(value, str) else value)})

    def final(self, **folds: tuple[Monoid, Column]) -> DataFrame:
        """Keys with their last totals, at the time of their last event."""
        return running.final(self.df, self.keys, folds)

    def previous_and_current(self) -> KeyedStream:
        return self._with(running.previous_and_current(self.df, self.keys, self.value_columns), ["previous", "current"])

    def left_join(self, other: KeyedStream, split_ms: int | None = None) -> KeyedStream:
        """Each event with the latest event of ``other`` of its key at or before its time, as structs l and r.

        Joined streams may be joined again; l then nests.
        """
        self._same_keys(other)
        return KeyedStream(joins.point_in_time_left(self.df, other.df, self.keys, self.value_columns, other.value_columns, split_ms), self.keys, ["l", "r"])

    def debounced_left_join(self, other: KeyedStream, latency_ms: int) -> KeyedStream:
        """The latest pair of each key, once the key has been quiet for ``latency_ms``."""
        self._same_keys(other)
        return KeyedStream(joins.debounced_left(self.df, other.df, self.keys, self.value_columns, other.value_columns, latency_ms), self.keys, ["l", "r"])

    def _same_keys(self, other: KeyedStream) -> None:
        if self.keys != other.keys:
            raise ValueError(f"keys differ: {self.keys} and {other.keys}")

    def window(self, window: TrailingWindow, **aggregates: Column) -> KeyedStream:
        """Aggregates over the trailing window; events of equal time see each other."""
        return self._with(windows.trailing(self.df, self.keys, window, aggregates), [*self.value_columns, *aggregates])

    def window_in_arrival(self, window: TrailingWindow, order: list[str | Column] | None = None, **sums: tuple[str, Column]) -> KeyedStream:
        """Sums and counts over the trailing window; later arrivals of equal time are not yet seen."""
        return self._with(windows.trailing_in_arrival(self.df, self.keys, window, sums, order), [*self.value_columns, *sums])

    def window_python(self, window: TrailingWindow, value: str, function: Callable, name: str, result_type: str) -> KeyedStream:
        """A Python aggregate over the trailing window; see ``operators.windows.trailing_python``."""
        return self._with(windows.trailing_python(self.df, self.keys, window, value, function, name, result_type), [*self.value_columns, name])

    def window_fold(self, window: TrailingWindow, value: Column, body: Callable[[Column], Column], name: str, order: list[str] | None = None) -> KeyedStream:
        """Any function of the values seen at each event; see ``operators.windows.trailing_fold``."""
        return self._with(windows.trailing_fold(self.df, self.keys, window, value, body, name, order), [*self.value_columns, name])

    def window_distinct(self, window: TrailingWindow, value: Column, name: str) -> KeyedStream:
        return self._with(windows.trailing_distinct(self.df, self.keys, window, value, name), [*self.value_columns, name])


__all__ = ["COUNT", "MAX", "MIN", "SUM", "EventStream", "KeyedStream"]
