"""Monoids of running folds.

A fold starts at ``zero`` and takes values in event order; nothing says that
``plus`` is associative, so folds are never reordered unless ``native`` gives an
aggregate that Spark may compute in parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """``plus(state, value)`` and ``zero`` over Columns; ``native`` an equal aggregate; ``step`` the same in Python."""

    name: str
    zero: Callable[[], Column]
    plus: Callable[[Column, Column], Column]
    native: Callable[[Column], Column] | None = None
    #: Puts the fold of the rows before a split and the fold within it together.
    join: Callable[[Column, Column], Column] | None = None
    step: Callable[[Any, Any], Any] | None = None


def _skip_null(fold: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(fold(a, b))


def _step(fold: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    return lambda a, b: a if b is None else b if a is None else fold(a, b)


_null = lambda: F.lit(None)
SUM = Monoid("sum", _null, _skip_null(lambda a, b: a + b), F.sum, _skip_null(lambda a, b: a + b), _step(lambda a, b: a + b))
MIN = Monoid("min", _null, _skip_null(F.least), F.min, _skip_null(F.least), _step(min))
MAX = Monoid("max", _null, _skip_null(F.greatest), F.max, _skip_null(F.greatest), _step(max))
COUNT = Monoid("count", lambda: F.lit(0).cast("bigint"), lambda a, b: a + F.when(b.isNull(), 0).otherwise(1), F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b, lambda a, b: (a or 0) + (b is not None))
LATEST = Monoid("latest", _null, lambda a, b: F.coalesce(b, a), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a), lambda a, b: a if b is None else b)
#: Not associative: the state is the pair (previous, current).
PREVIOUS = Monoid("previous", _null, lambda a, b: F.struct(a["current"].alias("previous"), b.alias("current")), None, None, lambda a, b: (a[1] if a else None, b))
