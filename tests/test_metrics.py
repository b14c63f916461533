from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.operators import metrics, traces

T0 = datetime(2024, 1, 1, 23, 58)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def messages(spark, rows):
    return spark.createDataFrame([(at(s), t) for s, t in rows], "ts timestamp, topic string")


def test_windows_are_half_open(spark):
    rows = messages(spark, [(0, "a"), (59, "a"), (60, "a")])
    got = {r.window_start: (r.messages, r.per_second) for r in metrics.message_rate(rows).collect()}
    assert got == {at(0): (2, 2 / 60), at(60): (1, 1 / 60)}


def test_sliding_windows(spark):
    rows = messages(spark, [(0, "a")])
    assert metrics.message_rate(rows, slide="5 seconds").count() == 12


def test_idle_topics_across_midnight(spark):
    rows = messages(spark, [(0, "a"), (1, "b"), (130, "a"), (131, "c"), (300, "b")])
    got = {
        int((r.window_start - T0).total_seconds()): (r.known, r.active, r.idle)
        for r in metrics.idle_topics(rows).collect()
    }
    assert got == {
        0: (2, 2, 0), 60: (2, 0, 2), 120: (3, 2, 1), 180: (3, 0, 3), 240: (3, 0, 3), 300: (3, 1, 2),
    }


def test_idle_topics_with_windows_that_cross_midnight(spark):
    """Windows of seven minutes do not start at midnight."""
    rows = messages(spark, [(0, "a"), (3000, "b")])
    got = metrics.idle_topics(rows, seconds=420).orderBy("window_start").collect()
    steps = {(b.window_start - a.window_start).total_seconds() for a, b in zip(got, got[1:])}
    assert steps == {420.0}
    assert (got[0].known, got[-1].known, got[-1].idle) == (1, 2, 1)


def test_no_messages_at_all(spark):
    nothing = messages(spark, [(0, "a")]).where("topic = 'none'")
    assert metrics.idle_topics(nothing).count() == 0
    assert metrics.message_rate(nothing).count() == 0


def test_top_topics(spark):
    rows = messages(spark, [(i % 50, f"t{i % n}") for n in (3, 7, 9) for i in range(100)])
    got = metrics.top_topics(rows, k=2).orderBy("rank").collect()
    counts = {}
    for n in (3, 7, 9):
        for i in range(100):
            counts[f"t{i % n}"] = counts.get(f"t{i % n}", 0) + 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:2]
    assert [(r.topic, r.messages) for r in got] == want
    plan = metrics.top_topics(rows, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_active_and_average(spark):
    rows = messages(spark, [(0, "a"), (1, "a"), (2, "b"), (61, "a")])
    assert [r.active for r in metrics.active_topics(rows).orderBy("window_start").collect()] == [2, 1]
    rates = metrics.avg_topic_rate(rows).orderBy("window_start").collect()
    assert [r.per_second_and_topic for r in rates] == [3 / 60 / 2, 1 / 60]


def test_counter_resets(spark):
    values = [(0, 5.0), (10, 8.0), (20, 2.0), (70, 4.0)]
    rows = spark.createDataFrame([("s", at(t), v) for t, v in values], "s string, ts timestamp, value double")
    got = metrics.counter_rate(rows, ["s"]).orderBy("window_start").collect()
    assert [r.increase for r in got] == [3.0 + 2.0, 2.0]


def test_lag_and_bands(spark):
    rows = spark.createDataFrame([("t", 0, 9), ("t", 0, 4), ("t", 1, 2)], "topic string, partition int, offset bigint")
    committed = spark.createDataFrame([("t", 0, 7)], "topic string, partition int, committed bigint")
    assert {r.partition: r.lag for r in metrics.consumer_lag(rows, committed).collect()} == {0: 2, 1: 3}
    bands = spark.createDataFrame([(0,), (99,), (100,), (5000,), (None,)], "v int").select(
        metrics.threshold_band(F.col("v"), [(1000, "red"), (100, "orange")], "green").alias("b")
    )
    assert [r.b for r in bands.collect()] == ["green", "green", "orange", "red", None]


def test_gauges(spark):
    rows = spark.createDataFrame([("a", at(0), 0.0), ("a", at(9), 1.0), ("b", at(5), 0.0), ("c", at(1), 7.0)], "s string, ts timestamp, value double")
    got = {r.s: r.status for r in metrics.status_map(metrics.gauge_last(rows, ["s"])).collect()}
    assert got == {"a": "UP", "b": "DOWN", "c": None}


def test_latency(spark):
    rows = spark.createDataFrame([(at(0), d) for d in (1, 2, 3, 4, 100)], "ts timestamp, delay int")
    received = F.timestamp_micros(F.unix_micros("ts") + F.col("delay") * 1000)
    row = traces.ingress_latency(rows, received, F.unix_millis("ts"), ["ts"]).collect()[0]
    assert (row.n, row.mean, row.p50, row.lowest, row.highest) == (5, 22.0, 3.0, 1, 100)
