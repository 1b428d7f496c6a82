"""Reserved column names, event-time expressions and checks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event time in epoch milliseconds; the same as a timestamp, inside SQL; arrival order among equal times.
TS, ROW_TIME, SEQ = "ts__", "row_time__", "seq__"
RESERVED = (TS, ROW_TIME, SEQ)


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a timestamp, rounded down, or of a column that holds them already.

    A timestamp without time zone is read as UTC, whatever the session's zone.
    """
    kind = dict(df.dtypes)[column]
    if kind in ("bigint", "int"):
        return F.col(column).cast("bigint")
    if kind == "timestamp":
        return F.unix_millis(F.col(column))
    if kind == "timestamp_ntz":
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
        return F.floor((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("bigint")
    if kind == "date":
        return F.unix_millis(F.col(column).cast("timestamp"))
    raise TypeError(f"{column} is {kind}, no time")


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def check_free(df: DataFrame) -> None:
    taken = [c for c in df.columns if c in RESERVED]
    if taken:
        raise ValueError(f"reserved column names are taken: {', '.join(taken)}")


def interval(start: str, end: str) -> tuple[int, int]:
    """Epoch milliseconds of two ISO-8601 instants; one without offset is UTC."""
    out = []
    for text in (start, end):
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        out.append(round(at.timestamp() * 1000))
    if out[0] > out[1]:
        raise ValueError(f"{start} is after {end}")
    return out[0], out[1]
