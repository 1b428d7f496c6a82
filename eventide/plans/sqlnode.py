"""SQL over a stream: text rewrites, then Spark's own parser and optimizer."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventide.functions.scalar import register
from eventide.schema import ROW_TIME, SEQ, TS

_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`)")


def outside_quotes(query: str, pattern: str, replacement) -> str:
    """``re.sub`` on what is not quoted."""
    parts = _QUOTED.split(query)
    return "".join(p if i % 2 else re.sub(pattern, replacement, p, flags=re.IGNORECASE) for i, p in enumerate(parts))


def rewrite(query: str, approximate_distinct: bool = False) -> str:
    """The query in Spark's dialect, with the event time and order as its first columns.

    * ``ts__`` and ``seq__`` are put after SELECT (a query that groups has no ``seq__``: 0);
    * interval precisions such as DAY(3), which Spark does not parse, are dropped;
    * ``count(distinct c) over (...)``, which Spark rejects, becomes the size of a
      set, or ``approx_count_distinct`` if asked for;
    * ``ASStddev`` is ``stddev_samp``.
    """
    text = query.strip().rstrip(";")
    if not re.match(r"select\s", text, re.IGNORECASE):
        raise ValueError("a stream query must begin with SELECT")
    if re.match(r"select\s+distinct\s", text, re.IGNORECASE):
        raise ValueError("SELECT DISTINCT has no single event time for a row")
    order = f"0 AS {SEQ}" if re.search(r"\bgroup\s+by\b", text, re.IGNORECASE) else SEQ
    text = re.sub(r"^select\s", f"SELECT {TS}, {order}, ", text, count=1, flags=re.IGNORECASE)
    text = outside_quotes(text, r"\b(year|month|day|hour|minute|second)\s*\(\s*\d+\s*\)", r"\1") if re.search(r"interval", text, re.IGNORECASE) else text
    text = outside_quotes(text, r"\bASStddev\s*\(", "stddev_samp(")
    return _distinct_windows(text, approximate_distinct)


def _distinct_windows(text: str, approximate: bool) -> str:
    """count(distinct x) over (...): both bracketed parts are found by counting brackets."""
    start = re.compile(r"\bcount\s*\(\s*distinct\b", re.IGNORECASE)
    at = 0
    while found := start.search(text, at):
        inner_end = _closing(text, text.index("(", found.start()))
        over = re.compile(r"\s*over\s*\(", re.IGNORECASE).match(text, inner_end + 1)
        if not over:
            at = found.end()
            continue
        end = _closing(text, over.end() - 1)
        value, frame = text[found.end() : inner_end].strip(), text[over.end() - 1 : end + 1]
        made = f"CAST(approx_count_distinct({value}) OVER {frame} AS INT)" if approximate else f"size(collect_set({value}) OVER {frame})"
        text, at = text[: found.start()] + made + text[end + 1 :], found.start() + len(made)
    return text


def _closing(text: str, opening: int) -> int:
    depth, quote = 0, ""
    for i in range(opening, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
    raise ValueError("brackets do not match")


def run_sql(df: DataFrame, query: str, table: str, schema: str | StructType | None = None, approximate_distinct: bool = False) -> DataFrame:
    """The result of a SELECT over the stream ``table``, its rows' event times kept.

    The table has the payload columns, ``ts__`` (epoch ms) and ``row_time__`` (the
    same as a timestamp, to the millisecond). Result columns are bound to ``schema``
    by position. A query that puts rows together (GROUP BY) is rejected unless it
    gives ts__ itself. The table is a common table expression over a private view, so
    streams cannot clash, and columns may have the table's name.
    """
    spark = df.sparkSession
    register(spark)
    text = rewrite(query, approximate_distinct)
    view = f"stream_{uuid.uuid4().hex}"
    if not re.search(rf"\b{re.escape(table)}\b", text, re.IGNORECASE):
        raise ValueError(f"the query does not read {table}")
    df.withColumn(ROW_TIME, F.timestamp_millis(F.col(TS))).createOrReplaceTempView(view)
    try:
        out = spark.sql(f"WITH `{table}` AS (SELECT * FROM {view}) {text}")
    except AnalysisException as fault:
        if re.search(r"\bgroup\s+by\b", text, re.IGNORECASE):
            raise ValueError("GROUP BY gives no event time for its rows; aggregate OVER a window instead") from fault
        raise
    finally:
        spark.catalog.dropTempView(view)
    values = out.columns[2:]
    if schema is not None:
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if len(kind) != len(values):
            raise ValueError(f"the query has {len(values)} columns, the schema {len(kind)}")
        out = out.toDF(TS, SEQ, *[f.name for f in kind]).select(TS, SEQ, *[F.col(f.name).cast(f.dataType) for f in kind])
    elif len(set(values)) < len(values):
        raise ValueError("column names repeat: name them or give a schema")
    return out
