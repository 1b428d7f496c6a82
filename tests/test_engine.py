"""Fixed cases: functions, SQL node, sources, event-time rules, registered queries."""

import oracle
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from eventide import EventStream, TrailingWindow
from eventide.functions import get_age, normalize_name, register, unix_time
from eventide.plans import catalog
from eventide.plans.eventtime import adjusted_times, replayed_watermarks
from eventide.plans.sqlnode import rewrite
from eventide.schema import interval
from eventide.sources import InMemorySource, TableSource, TextSource, collect_events, debug_dump, latest_daily_path, write_events

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    assert oracle.assert_same(catalog.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), catalog.ORACLE_SQL[name]) > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["ms", "user_id", "event_id", "total"] and not df.isEmpty()
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_functions(spark):
    ts = F.lit(100).cast("bigint")
    row = one(spark, unix_time(ts, "yyyy"), unix_time(ts, "yyyy-MM"), unix_time(ts, "yyyy-MM-dd"))
    assert tuple(row) == ("1970", "1970-01", "1970-01-01")
    ages = one(spark, *[get_age(ts, F.lit(d).cast("string")).alias(f"c{i}") for i, d in enumerate([None, "xxx", "1900-01-01", "2000-01-01", "1990-13-01"])])
    assert tuple(ages) == (100, 100, 70, 0, 100)
    assert one(spark, get_age(F.lit(None).cast("bigint"), F.lit("1990-01-01")).alias("a"))["a"] is None
    assert tuple(one(spark, *[normalize_name(F.lit(x).cast("string")).alias(f"c{i}") for i, x in enumerate([None, "ABc", "ABc Def"])])) == ("", "abc", "abcdef")
    with pytest.raises(Exception, match="format"):
        one(spark, unix_time(ts, F.lit(None).cast("string")).alias("x"))
    register(spark)
    register(spark)
    assert spark.sql("select UnixTime(100, 'yyyy'), GetAge(100, '1900-01-01'), NormalizeName('A b')").first()[:] == ("1970", 70, "ab")
    with pytest.raises(Exception, match="format"):
        spark.sql("select UnixTime(100, null)").collect()


def test_years_of_birth_of_more_than_four_digits(spark):
    year_12000 = 316_516_204_800_000
    dates = ["11950-06-15", "+11950-06-15", "12000-02-29", "300000-01-01", "9" * 30 + "-01-01", "11950-02-29", "11950-13-01", "x11950-06-15", "11950-06-15x"]
    wanted = (50, 50, 0, 0, 0, 100, 100, 100, 100)
    register(spark)
    assert tuple(one(spark, *[get_age(F.lit(year_12000), F.lit(d)).alias(f"c{i}") for i, d in enumerate(dates)])) == wanted
    assert tuple(one(spark, *[F.expr(f"GetAge({year_12000}, '{d}')").alias(f"c{i}") for i, d in enumerate(dates)])) == wanted
    assert one(spark, get_age(F.lit(year_12000), F.expr("date'2000-01-01'")).alias("a"))["a"] == 10000


def test_age_of_many_odd_and_missing_users(spark, tmp_path):
    users = "(values (null), (-2), (-1), (0), (1), (2), (71), (74), (8048), (8051), (89999), (5879630), (1000000000001)) u(user_id)"
    times = "(values (timestamp '2024-01-30 10:00:00.000001'), (timestamp '1969-12-31 23:59:59.999999'), (timestamp '9999-12-31'), (null)) t(ts)"
    con = oracle.connect(str(tmp_path))
    con.execute(f"copy (select row_number() over () as event_id, ts, cast(user_id as bigint) as user_id from {users}, {times}) to '{tmp_path}/events.parquet'")
    assert oracle.assert_same(catalog.QUERIES["fn_get_age"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalog.ORACLE_SQL["fn_get_age"]) == 52


def test_functions_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, unix_time(F.lit(100).cast("bigint"), "yyyy-MM-dd").alias("x"))["x"] == "1970-01-01"
        found = TableSource(f"{FOLDER}/events.parquet", ts="ts", seq="event_id", columns=["event_id"]).batch(spark).df.agg(F.min("ts__")).first()[0]
        wanted = oracle.connect(FOLDER).execute("select min((epoch_us(ts) - epoch_us(ts) % 1000) // 1000) from events").fetchone()[0]
        assert found == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def spread(spark, values):
    rows = [(1708403000000 + i * 300_000, "a", v) for i, v in enumerate(values)]
    keyed = InMemorySource(rows, "k string, v double").batch(spark).key_by("k").window(TrailingWindow(600_000), s=F.stddev_samp("v"))
    return [None if r["s"] is None else round(r["s"], 4) for r in collect_events(keyed.events().df)]


def test_standard_deviation(spark):
    assert spread(spark, [3.0, 6.0, 9.0, 12.0]) == [None, 2.1213, 3.0, 3.0]
    rows = [(i, "a", 0.001) for i in range(300)]
    keyed = InMemorySource(rows, "k string, v double").batch(spark).key_by("k").window(TrailingWindow(600_000), s=F.stddev_samp("v"))
    assert all(r["s"] is None or abs(r["s"]) < 1e-9 for r in keyed.events().df.collect())


def test_sql_rewrites():
    assert rewrite("select a from t").startswith("SELECT ts__, seq__, a")
    assert "DAY PRECEDING" in rewrite("SELECT sum(a) OVER (ORDER BY row_time__ RANGE BETWEEN INTERVAL '1' DAY(3) PRECEDING AND CURRENT ROW) FROM t")
    assert "size(collect_set(a) OVER (PARTITION BY b))" in rewrite("SELECT COUNT( DISTINCT a ) over (PARTITION BY b) FROM t")
    assert "approx_count_distinct(a)" in rewrite("SELECT count(distinct a) OVER (PARTITION BY b) FROM t", True)
    assert "'count(distinct x)'" in rewrite("SELECT 'count(distinct x)' FROM t")
    assert "stddev_samp(v)" in rewrite("SELECT ASStddev(v) OVER (PARTITION BY b) FROM t")
    for bad in ("", "sel", "with x as (select 1) select * from x", "SELECT DISTINCT a FROM t"):
        with pytest.raises(ValueError):
            rewrite(bad)


def test_sql_node(spark):
    events = InMemorySource([(1, "a", 1), (2, "a", None), (3, "b", 2)], "k string, c int").batch(spark)
    counted = events.sql("SELECT k, count(c) OVER (PARTITION BY k) FROM t", "t", "k string, n bigint").df
    assert sorted(tuple(r) for r in counted.select("ts__", "k", "n").collect()) == [(1, "a", 1), (2, "a", 1), (3, "b", 1)]
    with pytest.raises(ValueError, match="GROUP BY"):
        events.sql("SELECT k, count(*) AS n FROM t GROUP BY k", "t")
    assert not events.sql("SELECT k, count(*) AS n FROM t GROUP BY ts__, k", "t").df.isEmpty()
    with pytest.raises(ValueError, match="columns"):
        events.sql("SELECT k FROM t", "t", "a string, b int")
    with pytest.raises(ValueError, match="does not read"):
        events.sql("SELECT 1", "t")
    names = [t.name for t in spark.catalog.listTables()]
    assert not [n for n in names if n.startswith("stream_")]


def test_streams_check_their_columns(spark):
    with pytest.raises(ValueError, match="ts__"):
        EventStream(spark.range(1))
    with pytest.raises(ValueError, match="reserved"):
        TableSource("x", ts="a")  # a descriptor alone reads nothing
        from eventide.sources.read import as_events

        as_events(spark.range(1).select(F.col("id").alias("ts__")), "ts__")
    a = InMemorySource([(0, "x", 1)], "k string, v int").batch(spark)
    with pytest.raises(ValueError, match="keys differ"):
        a.key_by("k").left_join(a.key_by("v"))
    assert interval("2024-01-01", "2024-01-02T00:00:00Z") == (1704067200000, 1704153600000)
    with pytest.raises(ValueError):
        interval("2024-01-02", "2024-01-01")


def test_empty_input(spark):
    a = InMemorySource([], "k string, v int").batch(spark).key_by("k")
    from eventide import SUM

    for found in (a.sum("v", "s"), a.left_join(a), a.debounced_left_join(a, 1), a.window(TrailingWindow(1), n=F.count("*")), a.running(split_ms=5, s=(SUM, F.col("v")))):
        assert found.events().df.isEmpty()


def test_word_count(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b c\nc a a\n")
    with pytest.raises(ValueError, match="event time"):
        TextSource(str(tmp_path)).batch(spark)
    lines = TextSource(str(tmp_path), ts=F.lit(5)).batch(spark)
    words = lines.flat_map(F.split("value", " "), "word")
    from eventide import COUNT

    final = words.key_by("word").df.groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in final} == {"a": 3, "b": 1, "c": 2}
    found = words.key_by("word").running(n=(COUNT, F.lit(1))).events().df
    assert sorted(r["n"] for r in found.where("word = 'a'").collect()) == [1, 2, 3]


def test_files(spark, tmp_path):
    events = InMemorySource([(5, "a", 1), (3, "b", 2)], "k string, v int").batch(spark)
    for day in ("2024-01-02", "2023-12-31", "2024-01-10"):
        write_events(events.df, str(tmp_path / day))
    (tmp_path / "notes").mkdir()
    newest = latest_daily_path(spark, str(tmp_path))
    assert newest.endswith("2024-01-10")
    with pytest.raises(FileNotFoundError):
        latest_daily_path(spark, str(tmp_path / "notes"))
    again = TableSource(newest, ts="time").batch
    with pytest.raises(Exception):
        again(spark)
    assert [tuple(r) for r in collect_events(events.df)] == [(3, "b", 2), (5, "a", 1)]
    debug_dump(events.df, None, "x")
    debug_dump(events.df, str(tmp_path / "dump"), "step")
    assert spark.read.json(str(tmp_path / "dump" / "step")).count() == 2


def test_adjusted_times(spark):
    import listoracle as lists

    df = spark.createDataFrame([(i, 1, n) for i, n in enumerate([1, 1, 2, 3, 7, 5])], "i int, e bigint, n bigint")
    assert [r["adjusted"] for r in adjusted_times(df, "e", "n", ["i"], caught_up=True, one_task=True).orderBy("i").collect()] == [1, 2, 3, 4, 7, 8]
    rows = [(0, 50_000), (100, 60_000), (55_000, 61_000), (0, 61_000), (1, 61_500), (2, 61_500), (3, 61_501)]
    df = spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(rows)], "i int, e bigint, n bigint")
    assert [r["adjusted"] for r in adjusted_times(df, "e", "n", ["i"], one_task=True).orderBy("i").collect()] == lists.adjusted(rows)


# fixed values: clock and event time of each event, in seconds after 1609459000
#: Seconds at which events are seen, their times, and the watermark at each second in between, in ms.
REPLAY = [
    (1609459111, 1609459076), (1609459114, 1609459073), (1609459130, 1609459070), (1609459141, 1609459080), (1609459150, 1609459133), (1609459161, 1609459133), (1609459173, 1609459174), (1609459186, 1609459192),
    (1609459199, 1609459176), (1609459199, 1609459157), (1609459205, 1609459211), (1609459216, 1609459167), (1609459217, 1609459216), (1609459220, 1609459189), (1609459231, 1609459228), (1609459236, 1609459238),
    (1609459239, 1609459224), (1609459247, 1609459198), (1609459248, 1609459224), (1609459257, 1609459211),
]
MARKS = [
    1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000,
    1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609459076000, 1609459076000, 1609459076000, 1609459076000,
    1609459076000, 1609459076000, 1609459076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609458076000,
    1609458076000, 1609458076000, 1609458076000, 1609458076000, 1609459076000, 1609459076000, 1609458080000, 1609458080000,
    1609458080000, 1609458080000, 1609458080000, 1609458080000, 1609458080000, 1609458080000, 1609458080000, 1609458133000,
    1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000,
    1609459133000, 1609459133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000, 1609458133000,
    1609458133000, 1609458133000, 1609458133000, 1609459133000, 1609459133000, 1609459133000, 1609459174000, 1609459174000,
    1609459174000, 1609459174000, 1609459174000, 1609459174000, 1609459174000, 1609459174000, 1609459174000, 1609459174000,
    1609459174000, 1609459174000, 1609459174000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000,
    1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000,
    1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459192000, 1609459211000, 1609459211000,
    1609459211000, 1609459211000, 1609459211000, 1609459211000, 1609459211000, 1609459211000, 1609459211000, 1609459211000,
    1609459211000, 1609459211000, 1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000,
    1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000, 1609459216000,
    1609459228000, 1609459228000, 1609459228000, 1609459228000, 1609459228000, 1609459238000, 1609459238000, 1609459238000,
    1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000,
    1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000, 1609459238000,
    1609459238000, 1609459238000,
]


def test_hybrid_watermark(spark):
    seq, events, ticks = 0, [], []
    clock = 10**15  # the first event is seen long after its time
    for (now, event), (following, _) in zip(REPLAY, REPLAY[1:]):
        events.append((seq, clock, event * 1000))
        seq += 1
        for second in range(now, following):
            clock = second * 1000
            ticks.append((seq, clock))
            seq += 1
    both = spark.createDataFrame(events, "seq int, clock bigint, event_time bigint"), spark.createDataFrame(ticks, "seq int, clock bigint")
    with pytest.raises(ValueError):
        replayed_watermarks(*both, 1_000_000)
    found = replayed_watermarks(*both, 1_000_000, one_task=True)
    marks = [r["watermark"] for r in found.orderBy("seq").collect()]
    assert len(marks) == 146 and marks == MARKS
    assert marks[-1] == 1609459238000


def test_observed_delay(spark):
    from pyspark.sql import Observation

    from eventide.plans.eventtime import observed_delay

    df = spark.createDataFrame([(1, 4), (2, 3)], "e bigint, n bigint")
    seen = Observation("delay")
    late = F.col("n") - F.col("e")
    assert df.observe(seen, F.max(late).alias("max_delay_ms")).count() == 2 and seen.get["max_delay_ms"] == 3
    assert observed_delay(df, "e", "n").count() == 2


def test_approximate_distinct(spark):
    events = InMemorySource([(1, "a", 1), (2, "a", 2), (3, "a", 2)], "k string, c int").batch(spark)
    found = events.sql("SELECT k, count(distinct c) OVER (PARTITION BY k) AS n FROM t", "t", approximate_distinct=True)
    assert {r["n"] for r in found.df.collect()} == {2}


def test_plans(spark):
    """One sort and one exchange for many folds; filters and columns reach the scan."""
    plan = catalog.running_max(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") <= 2 and plan.count("Exchange hashpartitioning") <= 2
    plan = catalog.filter_even(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split(">")[0]


BIG = 2**53 + 1


def test_sql_keeps_order_among_equal_times(spark):
    """Ties stay in order of arrival after SQL, and a column may have the table's name."""
    rows = [(5, i, "k", 10 - i, BIG + i) for i in range(8)]
    df = spark.createDataFrame(rows, "ts__ bigint, seq__ int, k string, v int, e bigint").repartition(4)
    found = EventStream(df).sql("SELECT k, v, e FROM e WHERE v > 0", "e").key_by("k").previous_and_current().df.collect()
    assert sorted((r["previous"]["v"] if r["previous"] else None, r["current"]["v"], r["current"]["e"]) for r in found if r["previous"]) == sorted((10 - i, 9 - i, BIG + i + 1) for i in range(7))
    assert {r["seq__"] for r in found} == set(range(8))


def test_python_folds_keep_whole_numbers(spark):
    from eventide.operators.running import running_python

    rows = [(i, i, "k", i, BIG + i if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(rows, "ts__ bigint, seq__ int, k string, v int, big bigint")
    found = running_python(df, ["k"], "v", lambda a, b: a + b, 0, "s", "bigint").orderBy("ts__").collect()
    assert [r["big"] for r in found] == [r[4] for r in rows] and [r["s"] for r in found] == [0, 1, 3, 6, 10, 15]


def test_windows_take_an_order_among_equal_times(spark):
    rows = [(5, 0, "k", 3), (5, 1, "k", 1), (5, 2, "k", 2), (9, 3, "k", 7)]
    keyed = EventStream(spark.createDataFrame(rows, "ts__ bigint, seq__ int, k string, v int")).key_by("k")
    listed = lambda seen: F.array_join(F.transform(seen, lambda x: x["v"].cast("string")), ",")
    of = lambda stream, name: {r["v"]: r[name] for r in stream.df.collect()}
    assert of(keyed.window_fold(TrailingWindow(4), F.col("v"), listed, "seen"), "seen") == {3: "3", 1: "3,1", 2: "3,1,2", 7: "3,1,2,7"}
    assert of(keyed.window_fold(TrailingWindow(4), F.col("v"), listed, "seen", order=["v"]), "seen") == {1: "1", 2: "1,2", 3: "1,2,3", 7: "1,2,3,7"}
    assert of(keyed.window_in_arrival(TrailingWindow(4), n=("sum", F.col("v"))), "n") == {3: 3, 1: 4, 2: 6, 7: 13}
    assert of(keyed.window_in_arrival(TrailingWindow(4), order=["v"], n=("sum", F.col("v"))), "n") == {1: 1, 2: 3, 3: 6, 7: 13}


def test_every_operator_dumps_its_rows_when_asked(spark, tmp_path):
    spark.conf.set("eventide.debug.dir", str(tmp_path))
    try:
        stream = EventStream(spark.createDataFrame([(1, 0, "k", 1), (2, 1, "k", 5)], "ts__ bigint, seq__ int, k string, v int"))
        stream.filter(F.col("v") > 1).key_by("k").sum("v", "total")
    finally:
        spark.conf.unset("eventide.debug.dir")
    steps = sorted(p.name.split("-")[1] for p in tmp_path.iterdir())
    assert steps == ["filter", "key_by", "running", "test_every_operator_dumps_its_rows_when_asked"]
    total = next(p for p in tmp_path.iterdir() if p.name.endswith("running"))
    assert [r["total"] for r in spark.read.json(str(total)).collect()] == [5]


def test_print_and_delay(spark, capsys):
    from pyspark.sql import Observation

    from eventide.sources import print_events

    df = spark.createDataFrame([(10, 25), (20, 22)], "e bigint, n bigint")
    print_events(df)
    assert "25" in capsys.readouterr().out
    seen = Observation("delay")
    late = F.col("n") - F.col("e")
    df.observe(seen, F.max(late).alias("max_delay_ms")).collect()
    from eventide.plans.eventtime import observed_delay

    assert observed_delay(df, "e", "n").collect() and seen.get == {"max_delay_ms": 15}


def test_avro_schemas():
    from pyspark.sql.types import StructType

    from eventide.sources.avro import from_avro, to_avro

    schema = StructType.fromDDL("a int not null, b bigint, c string, d array<double>, e map<string, boolean>, f struct<x: date, y: binary>, g decimal(9, 2), h timestamp, i timestamp_ntz, j float")
    made = to_avro(schema, "row", "events")
    assert made["fields"][0] == {"name": "a", "type": "int"} and made["fields"][1] == {"name": "b", "type": ["null", "long"], "default": None}
    assert from_avro(made) == schema
    with pytest.raises(TypeError):
        from_avro({"type": "record", "name": "r", "fields": [{"name": "u", "type": ["int", "string"]}]})
    with pytest.raises(ValueError):
        to_avro(StructType.fromDDL("`a b` int"))
