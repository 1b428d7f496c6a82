"""Running folds: one output per event, in event order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from eventide.operators.monoid import Monoid
from eventide.schema import SEQ, TS


def in_order(keys: list[str], order: list[str | Column] | None = None) -> WindowSpec:
    """A key's events up to the present one: by time, then ``order``, then arrival."""
    return Window.partitionBy(*keys).orderBy(TS, *(order or []), SEQ).rowsBetween(Window.unboundedPreceding, 0)


def running(df: DataFrame, keys: list[str], folds: dict[str, tuple[Monoid, Column]], order: list[str | Column] | None = None, split_ms: int | None = None) -> DataFrame:
    """``df`` with a column per fold: ``plus`` over the key's events so far, the present one included.

    Native monoids share one exchange and one sort. A monoid without a native form
    is folded over the list of the events so far, which is quadratic in a key's
    events; ``running_python`` is linear.

    With ``split_ms`` a key's events are dealt out by time, each stretch is folded
    on its own, and the fold of all earlier stretches is put in front: a key that
    holds a large share of all events then occupies many tasks.
    """
    if split_ms is not None:
        return _running_split(df, keys, folds, order, split_ms)
    window = in_order(keys, order)
    made = {}
    for name, (monoid, value) in folds.items():
        if monoid.native:
            made[name] = monoid.native(value).over(window)
        else:
            made[name] = _folded(monoid, F.collect_list(F.struct(value.alias("v"))).over(window))
    return df.withColumns(made)


def _folded(monoid: Monoid, values: Column) -> Column:
    return F.aggregate(values, monoid.zero(), lambda state, x: monoid.plus(state, x["v"]))


def _running_split(df: DataFrame, keys: list[str], folds: dict[str, tuple[Monoid, Column]], order: list[str | Column] | None, split_ms: int) -> DataFrame:
    if any(m.native is None or m.join is None for m, _ in folds.values()):
        raise ValueError("only monoids with a native aggregate can be split by time")
    part = "__stretch"
    dealt = df.withColumn(part, F.floor(F.col(TS) / split_ms)).withColumns({f"__v_{n}": v for n, (_, v) in folds.items()})
    inner = in_order([*keys, part], order)
    within = dealt.withColumns({f"__in_{n}": m.native(F.col(f"__v_{n}")).over(inner) for n, (m, _) in folds.items()})

    def total(name: str, monoid: Monoid) -> Column:
        value = F.col(f"__v_{name}")
        if monoid.name == "latest":
            return F.max_by(value, F.when(value.isNotNull(), F.struct(TS, *(order or []), SEQ)))
        return monoid.native(value)

    sums = dealt.groupBy(*keys, part).agg(*[total(n, m).alias(f"__t_{n}") for n, (m, _) in folds.items()])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    again = lambda m, c: F.sum(c) if m.name == "count" else m.native(c)
    sums = sums.select(*keys, part, *[again(m, F.col(f"__t_{n}")).over(earlier).alias(f"__b_{n}") for n, (m, _) in folds.items()])
    # both sides are dealt by (keys, stretch); null keys must meet as well
    on = within[part] == sums[part]
    for k in keys:
        on = on & within[k].eqNullSafe(sums[k])
    joined = within.join(sums, on)
    return joined.select(*[within[c] for c in df.columns], *[m.join(sums[f"__b_{n}"], within[f"__in_{n}"]).alias(n) for n, (m, _) in folds.items()])


def running_python(df: DataFrame, keys: list[str], value: str, step: Callable, zero, name: str, result_type: str, order: list[str] | None = None) -> DataFrame:
    """A running fold by a Python function, linear in a key's events; the key's events must fit in a task."""
    columns = [TS, *(order or []), SEQ]
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {result_type}").fields])
    kind = to_arrow_type(schema[name].dataType)

    def fold(group: pa.Table) -> pa.Table:
        # Arrow keeps every column as it is: pandas makes floats of whole numbers with nulls
        group = group.sort_by([(c, "ascending") for c in columns])
        state, out = zero, []
        for v in group[value].to_pylist():
            state = step(state, v)
            out.append(state)
        return group.append_column(name, pa.array(out, kind))

    return df.groupBy(*keys).applyInArrow(fold, schema)


def final(df: DataFrame, keys: list[str], folds: dict[str, tuple[Monoid, Column]]) -> DataFrame:
    """The last total of each key, at the time of its last event; partial sums come before the shuffle."""
    if any(m.native is None for m, _ in folds.values()):
        raise ValueError("a final fold needs monoids with a native aggregate")
    made = [(F.max_by(v, F.when(v.isNotNull(), F.struct(TS, SEQ))) if m.name == "latest" else m.native(v)).alias(n) for n, (m, v) in folds.items()]
    return df.groupBy(*keys).agg(F.max(TS).alias(TS), *made)


def previous_and_current(df: DataFrame, keys: list[str], values: list[str], previous: str = "previous", current: str = "current") -> DataFrame:
    """Structs of the key's event before this one (null for the first) and of this one."""
    window = Window.partitionBy(*keys).orderBy(TS, SEQ)
    value = F.struct(*values)
    return df.withColumns({previous: F.lag(value).over(window), current: value})
