"""Stateful twins over file streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from eventide import MAX, SUM, TrailingWindow
from eventide.sources import TableSource
from eventide.streaming import backfill_then_live, debounced_left_stream, latest_left_stream, running_stream, trailing_stream, with_lateness

DAY = 86_400_000
LEFT, RIGHT = "ts__ bigint, seq__ int, k string, v int", "ts__ bigint, seq__ int, k string, w string"


def feed(spark, folder, schema, batches):
    """A stream that reads one batch of rows at a time, in this order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        newest = max((f for f in os.listdir(folder) if f.endswith(".json")), key=lambda f: os.stat(os.path.join(folder, f)).st_mtime_ns)
        os.utime(os.path.join(folder, newest), (time.time() - 1000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_running_fold(spark, tmp_path):
    source = feed(spark, tmp_path / "a", LEFT, [[(0, 0, "a", 1), (5, 1, "b", 7)], [(3, 2, "a", 4), (9, 3, "a", None)]])
    found = run(running_stream(source, ["k"], "v", SUM, "t", "int"), "folds")
    assert sorted(found) == [(0, 0, "a", 1, 1), (3, 2, "a", 4, 5), (5, 1, "b", 7, 7), (9, 3, "a", None, 5)]
    aged = run(running_stream(source, ["k"], "v", SUM, "t", "int", ttl_ms=3_600_000), "aged_folds")
    assert sorted(aged) == sorted(found)
    with pytest.raises(ValueError):
        running_stream(source, ["k"], "v", type(MAX)("x", None, None), "t", "int")


def test_late_events_give_their_own_window(spark, tmp_path):
    source = feed(spark, tmp_path / "a", LEFT, [[(0, 0, "1", 1)], [(DAY, 1, "1", 1)], [(4 * DAY, 2, "1", 1)], [(DAY, 3, "1", 1)]])
    found = run(trailing_stream(source, ["k"], TrailingWindow(DAY, 3_600_000), "v", sum, "t", "int"), "late")
    assert [r[-1] for r in sorted(found, key=lambda r: r[1])] == [1, 2, 1, 1]


def sides(spark, tmp_path):
    flush = [(t, 9, "flush", 0) for t in (10_000, 20_000)]
    left = feed(spark, tmp_path / "l", LEFT, [[(100, 0, "key1", 1), (300, 1, "key2", 2), (250, 2, "key3", 3)], flush[:1], flush[1:]])
    right = feed(spark, tmp_path / "r", RIGHT, [[(90, 0, "key1", "value1"), (290, 1, "key2", "value2"), (150, 2, "key3", "value3")], [(10_000, 9, "flush", "x")], [(20_000, 9, "flush", "x")]])
    return left, right


def test_latest_join(spark, tmp_path):
    found = run(latest_left_stream(*sides(spark, tmp_path), ["k"], ["v"], ["w"]), "latest")
    assert sorted(r[2:] for r in found if r[2] != "flush") == [("key1", 1, "value1"), ("key2", 2, "value2"), ("key3", 3, "value3")]


def test_debounced_join(spark, tmp_path):
    found = run(debounced_left_stream(*sides(spark, tmp_path), ["k"], ["v"], ["w"], 150), "debounced")
    assert sorted((r[0], *r[2:]) for r in found if r[2] != "flush") == [(251, "key1", 1, "value1"), (401, "key3", 3, "value3"), (451, "key2", 2, "value2")]


def test_debounced_join_waits_for_the_right_side(spark, tmp_path):
    left = feed(spark, tmp_path / "l", LEFT, [[(200, 0, "key1", 1)], [(9_000, 1, "flush", 0)], [(19_000, 1, "flush", 0)]])
    right = feed(spark, tmp_path / "r", RIGHT, [[(1000, 0, "key1", "value1")], [(9_000, 1, "flush", "x")], [(19_000, 1, "flush", "x")]])
    found = run(debounced_left_stream(left, right, ["k"], ["v"], ["w"], 1000), "right_late")
    assert [(r[0], *r[2:]) for r in found if r[2] == "key1"] == [(2001, "key1", 1, "value1")]


def test_stateless_operators_stream(spark, tmp_path):
    feed(spark, tmp_path / "a", "at bigint, k string, v int", [[(1, "a", 1), (2, "b", 2)], [(3, "a", 5)]])
    source = TableSource(str(tmp_path / "a"), ts="at", format="json", schema="at bigint, k string, v int")
    one, two = source.stream(spark), source.stream(spark).filter(F.col("v") > 1)
    assert one.is_streaming
    found = run(one.map("k", (F.col("v") * 2).alias("v")).union(two.map("k", "v")).df.drop("seq__"), "plain")
    assert sorted(found) == [(1, "a", 2), (2, "b", 2), (2, "b", 4), (3, "a", 5), (3, "a", 10)]
    with pytest.raises(ValueError, match="schema"):
        TableSource(str(tmp_path / "a"), ts="at", format="json").stream(spark)


def test_two_phase_watermark(spark, tmp_path):
    source = lambda: feed_again()
    feed(spark, tmp_path / "a", LEFT, [[(0, 0, "a", 1)], [(5000, 1, "a", 1)]])
    feed_again = lambda: spark.readStream.schema(LEFT).json(str(tmp_path / "a"))
    build = lambda delay: with_lateness(source(), delay).groupBy(F.window("row_time__", "1 second"), "k").agg(F.count("*").alias("n"))

    def start(df, backfill):
        writer = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
        return writer.trigger(availableNow=True).start() if backfill else writer.trigger(processingTime="1 second").start()

    live = backfill_then_live(build, start)
    live.processAllAvailable()
    live.stop()
    assert os.path.isdir(tmp_path / "out")


BIG = 2**53 + 1


def test_whole_numbers_stay_whole(spark, tmp_path):
    """Ids above 2 ** 53, with nulls beside them, through every stateful operator."""
    left, right = "ts__ bigint, seq__ int, k bigint, v bigint", "ts__ bigint, seq__ int, k bigint, w bigint"
    ends = [(t, 9, 0, 0) for t in (10_000, 20_000)]
    a = feed(spark, tmp_path / "l", left, [[(100, 0, BIG, BIG + 2), (110, 1, BIG, None)], ends[:1], ends[1:]])
    b = feed(spark, tmp_path / "r", right, [[(90, 0, BIG, BIG + 4)], ends[:1], ends[1:]])
    found = run(latest_left_stream(a, b, ["k"], ["v"], ["w"]), "big_latest")
    assert [r[2:] for r in found if r[2]] == [(BIG, BIG + 2, BIG + 4)]
    found = run(debounced_left_stream(a, b, ["k"], ["v"], ["w"], 1000), "big_debounced")
    assert [r[2:] for r in found if r[2]] == [(BIG, BIG + 2, BIG + 4)]
    found = run(running_stream(a, ["k"], "v", MAX, "top", "bigint"), "big_folds")
    assert sorted(r[1:] for r in found if r[2]) == [(0, BIG, BIG + 2, BIG + 2), (1, BIG, None, BIG + 2)]
    found = run(trailing_stream(a, ["k"], TrailingWindow(50), "v", lambda seen: max(x for x in seen if x is not None), "top", "bigint", ttl_ms=3_600_000), "big_windows")
    assert sorted(r[1:] for r in found if r[2]) == [(0, BIG, BIG + 2, BIG + 2), (1, BIG, None, BIG + 2)]


def test_debounced_join_forgets_idle_keys(spark, tmp_path):
    """A right value older than the time to live after the last pair is not joined again."""
    flush = lambda t: (t, 9, "flush", 0)
    batches = [[(100, 0, "a", 1)], [flush(5_000)], [flush(9_000)], [flush(90_000)], [flush(95_000)], [(96_000, 1, "a", 2)], [flush(200_000)], [flush(210_000)]]
    right = [[(90, 0, "a", "old")], *[[(b[0][0], 9, "flush", "x")] for b in batches[1:]]]
    for ttl, wanted in ((10_000, {(1, "old"), (2, None)}), (10**9, {(1, "old"), (2, "old")})):
        a, b = feed(spark, tmp_path / f"l{ttl}", LEFT, batches), feed(spark, tmp_path / f"r{ttl}", RIGHT, right)
        found = run(debounced_left_stream(a, b, ["k"], ["v"], ["w"], 1000, ttl_ms=ttl), f"idle{ttl}")
        assert {r[3:] for r in found if r[2] == "a"} == wanted


def test_a_query_goes_on_where_it_stopped(spark, tmp_path):
    """Restarted from its checkpoint, a fold gives each event once, with the state of before."""
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for batch in ([[(0, 0, "a", 1), (1, 1, "b", 5)]], [[(2, 2, "a", 10)], [(3, 3, "a", 100)]]):
        source = feed(spark, tmp_path / "in", LEFT, batch)
        query = running_stream(source, ["k"], "v", SUM, "t", "int").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r["seq__"], r["t"]) for r in spark.read.parquet(out).collect()) == [(0, 1), (1, 5), (2, 11), (3, 111)]


def test_socket(spark):
    import socket
    import threading

    from eventide.sources import TextSource

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        to, _ = server.accept()
        to.sendall(b"1 one\n2 two\n")
        time.sleep(20)
        to.close()

    threading.Thread(target=serve, daemon=True).start()
    lines = TextSource("", ts=F.split("value", " ")[0].cast("bigint"), socket=("127.0.0.1", server.getsockname()[1])).stream(spark)
    query = lines.df.writeStream.format("memory").queryName("lines").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("lines").count() < 2:
            query.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("lines").collect()) == [(1, 0, "1 one"), (2, 0, "2 two")]
    finally:
        query.stop()
        server.close()
