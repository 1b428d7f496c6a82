"""Watermarks of streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.schema import ROW_TIME, TS

#: How late an event may be while a stream catches up with its past.
MAX_LATENESS = "5 days"


def with_lateness(df: DataFrame, delay: str = MAX_LATENESS) -> DataFrame:
    """``df`` with ``row_time__`` and a watermark that trails it by ``delay``."""
    return df.withColumn(ROW_TIME, F.timestamp_millis(F.col(TS))).withWatermark(ROW_TIME, delay)


def backfill_then_live(build: Callable[[str], DataFrame], start: Callable[[DataFrame, bool], StreamingQuery], allowed: str = "0 seconds", max_delay: str = MAX_LATENESS) -> StreamingQuery:
    """A hybrid watermark in two phases: history with a wide delay, then live data with a narrow one.

    A query has one fixed delay, so the backlog is run to its end first
    (``start(df, True)`` is to use an availableNow trigger), and the live query
    goes on from the same checkpoint. ``build`` makes the query's DataFrame for a
    delay.
    """
    start(build(max_delay), True).awaitTermination()
    return start(build(allowed), False)
