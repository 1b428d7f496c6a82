"""Stateful operators on streaming DataFrames.

Each keeps what it needs of a key in the state store (RocksDB) and sees a key's
events of one micro-batch sorted by event time and sequence. State that only event
time can age is evicted by the processors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


from eventide.operators.monoid import Monoid
from eventide.operators.windows import TrailingWindow
from eventide.schema import SEQ, TS
from eventide.streaming.watermark import with_lateness


#: How long a debounced join remembers a key after its last pair.
DAY_MS = 86_400_000


def _ddl(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _integers(df: DataFrame) -> list[str]:
    """Columns of whole numbers: pandas turns those with nulls into floats, which lose digits."""
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")]


def _carried(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with whole numbers as strings, to be read again by ``_rows``; keys, by which rows are grouped, as they are."""
    return df.withColumns({f"key__{k}": F.col(k) for k in keys} | {c: F.col(c).cast("string") for c in _integers(df)}).groupBy(*[f"key__{k}" for k in keys])


def _rows(batches: Iterator[pd.DataFrame], order: list[str], integers: list[str]) -> list[dict[str, Any]]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return []
    rows = pd.concat(frames, ignore_index=True)
    for c in order:  # never null
        rows[c] = rows[c].astype("int64")
    rows = rows.sort_values(order, kind="stable")
    found = rows.astype(object).where(rows.notna(), None).to_dict("records")
    for row in found:
        for c in integers:
            if row.get(c) is not None:
                row[c] = int(row[c])
    return found


def _frame(rows: list[dict[str, Any]], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})


class _RunningFold(StatefulProcessor):
    def __init__(self, step: Callable, zero: Any, value: str, name: str, columns: list[str], state: str, integers: list[str], ttl_ms: int | None = None):
        self.integers, self.ttl = integers, ttl_ms
        self.step, self.zero, self.value, self.name, self.columns, self.kind = step, zero, value, name, columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", f"v {self.kind}", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else self.zero
        out = []
        for row in _rows(rows, [TS, SEQ], self.integers):
            now = self.step(now, row[self.value])
            out.append(row | {self.name: now})
        if now is not None:
            self.state.update((now,))
        yield _frame(out, [*self.columns, self.name])

    def close(self) -> None:
        pass


def running_stream(df: DataFrame, keys: list[str], value: str, monoid: Monoid, name: str, result_type: str, zero: Any = None, ttl_ms: int | None = None) -> DataFrame:
    """The running fold of each key, one output per event, in the order of arrival by micro-batch.

    With ``ttl_ms`` a key not seen for so long, by processing time, starts anew.
    """
    if monoid.step is None:
        raise ValueError(f"{monoid.name} has no Python step")
    out = f"{_ddl(df, df.columns)}, `{name}` {result_type}"
    return _carried(df, keys).transformWithStateInPandas(_RunningFold(monoid.step, zero, value, name, df.columns, result_type, _integers(df), ttl_ms), out, "append", "processingTime" if ttl_ms else "None")


class _LatestJoin(StatefulProcessor):
    def __init__(self, keys: list[str], left: list[str], right: list[str], state: str, integers: list[str], ttl_ms: int | None = None):
        self.integers, self.ttl = integers, ttl_ms
        self.keys, self.left, self.right, self.kind = keys, left, right, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("right", self.kind, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else None
        out, names = [], [f"r_{c}" for c in self.right]
        for row in _rows(rows, [TS, "side__", SEQ], self.integers):
            if row["side__"] == 0:
                found = tuple(row[n] for n in names)
                if any(x is not None for x in found):
                    now = found
            elif any(row[f"l_{c}"] is not None for c in self.left):
                out.append(row | dict(zip(names, now or [None] * len(names))))
        if now is not None:
            self.state.update(now)
        yield _frame(out, [TS, SEQ, *self.keys, *[f"l_{c}" for c in self.left], *names])

    def close(self) -> None:
        pass


def _both(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], extra: list[str]) -> DataFrame:
    kinds = {("l", f.name): f.dataType for f in left.schema} | {("r", f.name): f.dataType for f in right.schema}

    def tagged(df: DataFrame, side: int, own: str) -> DataFrame:
        columns = [(F.col(c) if own == s else F.lit(None).cast(kinds[s, c])).alias(f"{s}_{c}") for s, cs in (("l", left_values), ("r", right_values)) for c in cs]
        return df.select(TS, SEQ, *extra, *keys, F.lit(side).alias("side__"), *columns)

    return tagged(left, 1, "l").unionByName(tagged(right, 0, "r"))


def latest_left_stream(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Each left event with the latest right event that came before it, emitted at once.

    A right event that arrives later amends nothing. Within a micro-batch events
    are taken in event order, right before left. With ``ttl_ms`` a right value is
    forgotten so long after its arrival, by processing time. Columns: ts, seq, keys, l_*, r_*.
    """
    both = _both(left, right, keys, left_values, right_values, [])
    state = ", ".join(f"`{c}` {dict(right.dtypes)[c]}" for c in right_values)
    columns = [TS, SEQ, *keys, *[f"l_{c}" for c in left_values], *[f"r_{c}" for c in right_values]]
    return _carried(both, keys).transformWithStateInPandas(_LatestJoin(keys, left_values, right_values, state, _integers(both), ttl_ms), _ddl(both, columns), "append", "processingTime" if ttl_ms else "None")


class _DebouncedJoin(StatefulProcessor):
    def __init__(self, keys: list[str], left: list[str], right: list[str], state: str, latency: int, ttl: int, integers: list[str]):
        self.integers, self.ttl = integers, ttl
        self.keys, self.left, self.right, self.kind, self.latency = keys, left, right, state, latency

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pair", self.kind)
        self.timer = handle.getValueState("timer", "at bigint")
        self.expiry = handle.getValueState("expiry", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [*[f"l_{c}" for c in self.left], *[f"r_{c}" for c in self.right]]
        n = len(self.left)
        now = list(self.state.get()) if self.state.exists() else [None] * len(names)
        at, out = self.timer.get()[0] if self.timer.exists() else None, []
        for row in _rows(rows, [TS, "side__", SEQ], self.integers):
            ts = int(row[TS])
            if at is not None and ts >= at:  # its time had come before this event
                if any(x is not None for x in now[:n]):
                    out.append({TS: at, SEQ: 0} | dict(zip(self.keys, key)) | dict(zip(names, now)))
            part = slice(0, n) if row["side__"] == 1 else slice(n, None)
            found = [row[c] for c in names[part]]
            if any(x is not None for x in found):
                now[part] = found
            at = ts + self.latency + 1
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
            self.expiry.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))
            self.state.update(tuple(now))
        yield _frame(out, [TS, SEQ, *self.keys, *names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [*[f"l_{c}" for c in self.left], *[f"r_{c}" for c in self.right]]
        now = list(self.state.get()) if self.state.exists() else [None] * len(names)
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if not self.timer.exists() or self.timer.get()[0] != at:  # nothing came after the pair was given
            self.state.clear()
            self.expiry.clear()
            yield _frame(out, [TS, SEQ, *self.keys, *names])
            return
        self.timer.clear()
        self.handle.registerTimer(at + self.ttl)
        self.expiry.update((at + self.ttl,))
        if any(x is not None for x in now[: len(self.left)]):
            out.append({TS: at, SEQ: 0} | dict(zip(self.keys, key)) | dict(zip(names, now)))
        yield _frame(out, [TS, SEQ, *self.keys, *names])

    def close(self) -> None:
        pass


def debounced_left_stream(left: DataFrame, right: DataFrame, keys: list[str], left_values: list[str], right_values: list[str], latency_ms: int, delay: str = "0 seconds", ttl_ms: int = DAY_MS) -> DataFrame:
    """The latest pair of each key once event time has passed its last event by ``latency_ms``.

    Emission is at timer time, ts + latency + 1. Timers fire as the watermark
    passes them, so a finite input needs a later event to flush its last ones. A key of
    which nothing comes for ``ttl_ms`` after that, by event time, is forgotten.
    """
    both = with_lateness(_both(left, right, keys, left_values, right_values, []), delay)
    names = [*[f"l_{c}" for c in left_values], *[f"r_{c}" for c in right_values]]
    state = _ddl(both, names)
    columns = [TS, SEQ, *keys, *names]
    return _carried(both, keys).transformWithStateInPandas(_DebouncedJoin(keys, left_values, right_values, state, latency_ms, ttl_ms, _integers(both)), _ddl(both, columns), "append", "eventTime")


class _Trailing(StatefulProcessor):
    def __init__(self, window: TrailingWindow, value: str, body: Callable, name: str, columns: list[str], state: str, integers: list[str], ttl_ms: int | None = None):
        self.integers, self.ttl = integers, ttl_ms
        self.window, self.value, self.body, self.name, self.columns, self.kind = window, value, body, name, columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("kept", f"ts bigint, v {self.kind}", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(t), v) for t, v in self.state.get()] if self.state.exists() else []
        out = []
        for row in _rows(rows, [TS, SEQ], self.integers):
            ts = int(row[TS])
            at = len(kept)
            while at and kept[at - 1][0] > ts:  # after those of its own time
                at -= 1
            kept.insert(at, (ts, row[self.value]))
            found = self.body([v for t, v in kept[: at + 1] if t >= ts - self.window.size])
            if found is not None:
                out.append(row | {self.name: found})
        if kept:
            low = kept[-1][0] - self.window.kept
            self.state.put([x for x in kept if x[0] >= low])
        yield _frame(out, [*self.columns, self.name])

    def close(self) -> None:
        pass


def trailing_stream(df: DataFrame, keys: list[str], window: TrailingWindow, value: str, body: Callable[[list], Any], name: str, result_type: str, ttl_ms: int | None = None) -> DataFrame:
    """``body`` of the values in [ts - size, ts] seen so far, for each event, in the order of arrival.

    A late event gives its own result over what is kept (size + 14 slides behind
    the newest event) and changes no earlier one. A None result drops the event. With
    ``ttl_ms`` what is kept of an event is forgotten so long after its arrival, by
    processing time, so a key not seen again leaves no state.
    """
    kind = dict(df.dtypes)[value]
    return _carried(df, keys).transformWithStateInPandas(_Trailing(window, value, body, name, df.columns, kind, _integers(df), ttl_ms), f"{_ddl(df, df.columns)}, `{name}` {result_type}", "append", "processingTime" if ttl_ms else "None")


