"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from eventide.schema import SEQ, TS, payload


def write_events(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a batch of events, event time included; Avro needs Spark's avro module on the class path."""
    writer = df.drop(SEQ).write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def debug_dump(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Dump a step's rows as JSON below ``folder``; does nothing without one."""
    if folder:
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    return df


def print_events(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def collect_events(df: DataFrame) -> list[Row]:
    """Rows in the order of event time; for results known to be small."""
    return df.select(TS, *payload(df)).orderBy(TS, *([SEQ] if SEQ in df.columns else [])).collect()
