"""Source descriptors: one serves batch and streaming."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.schema import SEQ, TS, check_free, epoch_millis
from eventide.stream import EventStream


class Source(Protocol):
    """What a pipeline reads; ``stream`` may be missing."""

    def batch(self, spark: SparkSession) -> EventStream: ...

    def stream(self, spark: SparkSession) -> EventStream: ...


def as_events(df: DataFrame, ts: str | Column, seq: str | Column | None = None, columns: list[str] | None = None) -> EventStream:
    """A stream over a table: ``ts`` its event time, ``seq`` the order among equal times."""
    check_free(df)
    time = epoch_millis(df, ts) if isinstance(ts, str) else ts.cast("bigint")
    order = F.lit(0) if seq is None else F.col(seq) if isinstance(seq, str) else seq
    return EventStream(df.select(time.alias(TS), order.alias(SEQ), *(columns or df.columns)))


@dataclass
class TableSource:
    """Files of a Spark format. ``schema`` is needed for streaming, which reads a folder."""

    path: str
    ts: str
    seq: str | None = None
    format: str = "parquet"
    columns: list[str] | None = None
    schema: StructType | str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def batch(self, spark: SparkSession) -> EventStream:
        reader = spark.read.format(self.format).options(**self.options)
        return as_events((reader.schema(self.schema) if self.schema else reader).load(self.path), self.ts, self.seq, self.columns)

    def stream(self, spark: SparkSession) -> EventStream:
        if self.schema is None:
            raise ValueError("a streaming source needs its schema")
        return as_events(spark.readStream.format(self.format).options(**self.options).schema(self.schema).load(self.path), self.ts, self.seq, self.columns)


@dataclass
class TextSource:
    """Lines of text, one column ``value``.

    ``ts`` gives each line's event time from ``value``. Without it the time of
    processing counts, which no rerun repeats, so that must be asked for.
    ``socket`` is for development only.
    """

    path: str
    ts: Column | None = None
    processing_time: bool = False
    socket: tuple[str, int] | None = None

    def _events(self, df: DataFrame) -> EventStream:
        if self.ts is None and not self.processing_time:
            raise ValueError("lines have no event time: give ts, or processing_time=True")
        return as_events(df, self.ts if self.ts is not None else F.unix_millis(F.current_timestamp()))

    def batch(self, spark: SparkSession) -> EventStream:
        return self._events(spark.read.text(self.path))

    def stream(self, spark: SparkSession) -> EventStream:
        if self.socket:
            host, port = self.socket
            return self._events(spark.readStream.format("socket").option("host", host).option("port", port).load())
        return self._events(spark.readStream.text(self.path))


@dataclass
class InMemorySource:
    """Rows (event time, values...) in their order of arrival."""

    rows: Iterable[tuple]
    schema: str

    def batch(self, spark: SparkSession) -> EventStream:
        listed = [(row[0], i, *row[1:]) for i, row in enumerate(self.rows)]
        return EventStream(spark.createDataFrame(listed, f"{TS} bigint, {SEQ} int, {self.schema}"))

    def stream(self, spark: SparkSession) -> EventStream:
        raise NotImplementedError("rows in memory are batch only")


def latest_daily_path(spark: SparkSession, prefix: str, name: str = r"(\d{4}-\d{2}-\d{2})") -> str:
    """The path below ``prefix`` whose folder name is the latest date, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(prefix)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dated = []
    for status in files.listStatus(root):
        found = re.fullmatch(name, status.getPath().getName())
        if found and status.isDirectory():
            dated.append((found[1], str(status.getPath())))
    if not dated:
        raise FileNotFoundError(f"no dated folder below {prefix}")
    return max(dated)[1]
