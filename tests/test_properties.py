"""Operators against a list evaluator, on random events with equal times, nulls and few keys."""

import listoracle as lists
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide import COUNT, LATEST, MAX, MIN, PREVIOUS, SUM, TrailingWindow
from eventide.sources import InMemorySource

VALUES = st.one_of(st.none(), st.integers(-50, 50))
EVENTS = st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abc"), VALUES), min_size=1, max_size=25)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def stream(spark, rows):
    return InMemorySource(rows, "k string, v int").batch(spark).key_by("k")


def listed(rows):
    return [(ts, i, k, v) for i, (ts, k, v) in enumerate(rows)]


def got(keyed, *columns):
    return sorted(tuple(r) for r in keyed.events().df.select("ts__", "seq__", "k", *columns).collect())


@FEW
@given(EVENTS)
def test_running_folds(spark, rows):
    v = F.col("v")
    folds = {"s": (SUM, v), "n": (COUNT, v), "low": (MIN, v), "top": (MAX, v), "l": (LATEST, v)}
    for split in (None, 7):
        found = stream(spark, rows).running(split_ms=split, **folds)
        for name, (monoid, _) in folds.items():
            assert got(found, name) == sorted(lists.running(listed(rows), monoid.step, 0 if name == "n" else None)), (name, split)


@FEW
@given(EVENTS)
def test_folds_that_are_not_native(spark, rows):
    from eventide.operators.monoid import Monoid
    from eventide.operators.running import running_python

    # the order of the values counts
    odd = Monoid("odd", lambda: F.lit(0).cast("int"), lambda a, b: F.pmod(a * 2 + F.coalesce(b, F.lit(1)), F.lit(101)).cast("int"))
    step = lambda a, b: (a * 2 + (1 if b is None else int(b))) % 101
    wanted = sorted(lists.running(listed(rows), step, 0))
    keyed = stream(spark, rows)
    assert got(keyed.running(s=(odd, F.col("v"))), "s") == wanted
    python = running_python(keyed.df, ["k"], "v", step, 0, "s", "int")
    assert sorted(tuple(r) for r in python.select("ts__", "seq__", "k", "s").collect()) == wanted
    assert PREVIOUS.native is None


@FEW
@given(EVENTS)
def test_previous_and_current(spark, rows):
    found = stream(spark, rows).previous_and_current().events().df.select("k", "ts__", "seq__", "previous.v", F.col("current.v").alias("c")).collect()
    wanted = []
    for key, group in lists.by_key(listed(rows)).items():
        wanted += [(key, e[0], e[1], before[3] if before else None, e[3]) for before, e in zip([None, *group], group)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


@FEW
@given(EVENTS, EVENTS)
def test_left_joins(spark, left, right):
    a, b = stream(spark, left), stream(spark, right)
    wanted = sorted(lists.left_join(listed(left), listed(right)), key=str)
    for split in (None, 9):
        found = a.left_join(b, split_ms=split).events().df.select("ts__", "seq__", "k", F.col("l.v").alias("l"), F.col("r.v").alias("r")).collect()
        assert sorted(map(tuple, found), key=str) == wanted
    found = a.debounced_left_join(b, 5).events().df.select("ts__", "k", F.col("l.v").alias("l"), F.col("r.v").alias("r")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(lists.debounced(listed(left), listed(right), 5), key=str)


@FEW
@given(EVENTS)
def test_trailing_windows(spark, rows):
    window, keyed, v = TrailingWindow(10, 2), stream(spark, rows), F.col("v")
    some = lambda seen: [x for x in seen if x is not None]
    total = lambda seen: sum(some(seen)) if some(seen) else None
    found = keyed.window(window, s=F.sum("v"), n=F.count("v"))
    for name, body in (("s", total), ("n", lambda seen: len(some(seen)))):
        found_rows = [tuple(r) for r in found.events().df.select("ts__", "seq__", "k", name).collect()]
        assert sorted(found_rows, key=str) == sorted(lists.trailing_peers(listed(rows), 10, body), key=str)
    assert got(keyed.window_distinct(window, v, "d"), "d") == sorted(lists.trailing_peers(listed(rows), 10, lambda seen: len(set(some(seen)))))
    found = keyed.window_in_arrival(window, s=("sum", v), n=("count", v))
    rows_of = lambda name: sorted((tuple(r) for r in found.events().df.select("ts__", "seq__", "k", name).collect()), key=str)
    assert rows_of("n") == sorted(lists.trailing(listed(rows), 10, lambda seen: len(some(seen))), key=str)
    wanted = [(ts, seq, k, total([v for t, _, _, v in g[: i + 1] if t >= ts - 10])) for k, g in lists.by_key(listed(rows)).items() for i, (ts, seq, _, _) in enumerate(g)]
    assert rows_of("s") == sorted(wanted, key=str)
    last = keyed.window_fold(window, v, lambda seen: F.element_at(seen, -1)["v"], "last")
    assert sorted(got(last, "last"), key=str) == sorted(lists.trailing(listed(rows), 10, lambda seen: seen[-1]), key=str)


def test_other_windows_are_refused(spark):
    keyed = stream(spark, [(0, "a", 1)])
    with pytest.raises(ValueError, match="trailing"):
        keyed.window("tumbling", n=F.count("*"))
    with pytest.raises(ValueError):
        TrailingWindow(-1)
    with pytest.raises(ValueError, match="undone"):
        keyed.window_in_arrival(TrailingWindow(1), top=("max", F.col("v")))


@FEW
@given(EVENTS, EVENTS)
def test_plain_operators(spark, rows, more):
    one = InMemorySource(rows, "k string, v int").batch(spark)
    two = InMemorySource(more, "k string, v int").batch(spark)
    values = lambda s, c="v": sorted((r[0] for r in s.df.select(c).collect()), key=str)
    assert values(one.map((F.col("v") * 2).alias("v"))) == sorted([None if v is None else v * 2 for _, _, v in rows], key=str)
    assert values(one.filter(F.col("v") > 0)) == sorted([v for _, _, v in rows if v is not None and v > 0], key=str)
    many = one.flat_map(F.when(F.col("v") > 0, F.sequence(F.lit(1), F.col("v") % 4 + 1)), "n")
    assert values(many, "n") == sorted([n for _, _, v in rows if v is not None and v > 0 for n in range(1, v % 4 + 2)], key=str)
    assert values(one.union(two)) == sorted([v for _, _, v in [*rows, *more]], key=str)
    assert values(one.key_by("k").map_value("v").values()) == values(one)
