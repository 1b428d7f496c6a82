"""Scalar functions of feature pipelines."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What an unknown or unreadable birth date counts as.
UNKNOWN_AGE = 100

#: Years of more than four digits, which Spark's pattern reads only after a sign and only as far as its timestamps go.
_FAR = "^[+]?([0-9]{5,})-[0-9]{2}-[0-9]{2}$"
# such a date exists if that of the year's last four digits does: the calendar repeats every 400 years
_BORN = f"if(length(dob) > 10 and dob rlike '{_FAR}', if(try_to_timestamp(right(dob, 10), 'yyyy-MM-dd') is null, null, try_cast(regexp_extract(dob, '{_FAR}', 1) as double)), year(try_to_timestamp(dob, 'yyyy-MM-dd')))"

# SQL bodies, so that Columns and SQL functions cannot differ
_BODIES = {
    # the local time of the epoch plus ms is UTC whatever the session's zone
    "UnixTime": ("ts BIGINT, fmt STRING", "STRING", "if(fmt is null, raise_error('UnixTime needs a format'), date_format(timestampadd(MILLISECOND, ts, TIMESTAMP_NTZ'1970-01-01 00:00:00'), fmt))"),
    "GetAge": ("ts BIGINT, dob STRING", "INT", f"case when {_BORN} is null then {UNKNOWN_AGE} when ts is null then null else cast(greatest(year(timestampadd(MILLISECOND, ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')) - {_BORN}, 0) as int) end"),
    "NormalizeName": ("s STRING", "STRING", "replace(lower(coalesce(s, '')), ' ', '')"),
}


def _epoch(ts: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ts.cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def unix_time(ts: Column, fmt: Column | str) -> Column:
    """Epoch milliseconds as UTC text in a date pattern; a null pattern is an error."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.when(fmt.isNull(), F.raise_error(F.lit("UnixTime needs a format")).cast("string")).otherwise(F.call_function("date_format", _epoch(ts), fmt))


def get_age(ts: Column, dob: Column) -> Column:
    """Year of ``ts`` less year of birth (yyyy-MM-dd, the year of four digits or more), at least 0; 100 for a birth date that cannot be read."""
    pattern = F.lit("yyyy-MM-dd")
    exists = F.try_to_timestamp(F.right(dob, F.lit(10)), pattern).isNotNull()
    far = F.when(exists, F.regexp_extract(dob, _FAR, 1).try_cast("double"))
    born = F.when((F.length(dob) > 10) & F.rlike(dob, F.lit(_FAR)), far).otherwise(F.year(F.try_to_timestamp(dob, pattern)))
    return F.when(born.isNull(), UNKNOWN_AGE).when(ts.isNull(), F.lit(None)).otherwise(F.greatest(F.year(_epoch(ts)) - born, F.lit(0))).cast("int")


def normalize_name(name: Column) -> Column:
    """Lower case without spaces (U+0020); '' for null."""
    return F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit(""))


def register(spark: SparkSession) -> None:
    """UnixTime, GetAge and NormalizeName in SQL; doing it again changes nothing."""
    for name, (arguments, result, body) in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
