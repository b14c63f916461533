import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import envelope, metrics
from pulsegrid.schemas import MESSAGE_ROW
from pulsegrid.sources.messages import file_source
from pulsegrid.sources.tables import read_batches, read_telemetry
from pulsegrid.streaming import live
from tests.test_live import deliver

T0 = datetime(2024, 1, 1)


def said(i, topic, minutes, offset=None):
    value = json.dumps({"topic": topic, "payload": {"n": i}}).encode()
    return (None, value, "iot-stream", i % 2, i if offset is None else offset, T0 + timedelta(minutes=minutes), None)


TALK = [("a", 0), ("b", 0.5), ("a", 1), ("c", 7), ("a", 7.2), ("d", 30), ("a", 31), ("b", 31.5), ("e", 59), ("a", 90)]
ROWS = [said(i, topic, at) for i, (topic, at) in enumerate(TALK)]


@pytest.mark.parametrize("cuts", [[], [2, 5, 8]])
def test_idle_topics_of_complete_windows(spark, cuts, tmp_path):
    """Windows without a message have rows too, also between two micro-batches."""
    store = deliver(spark, ROWS, cuts, str(tmp_path), live.start_idle_topics)
    got = read_batches(spark, store.measure("idle_topics")).orderBy("window_start").collect()
    decoded = envelope.decode_envelope(spark.createDataFrame(ROWS, MESSAGE_ROW)).select("topic", F.col("timestamp").alias("ts"))
    done = metrics.idle_topics(decoded.where(F.col("ts") < F.lit(T0 + timedelta(minutes=80)))).orderBy("window_start").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in done] and len(got) == 60
    registry = {r.topic: r.first_seen for r in store.topics(spark).latest().collect()}
    assert registry == {"a": T0, "b": T0, "c": T0 + timedelta(minutes=7), "d": T0 + timedelta(minutes=30), "e": T0 + timedelta(minutes=59)}


def test_idle_topics_after_a_failure(spark, tmp_path, monkeypatch):
    """The batch runs again after its rows and its registry were written."""
    root, failures = str(tmp_path), []
    deliver(spark, ROWS[:5], [], root, live.start_idle_topics)
    spark.createDataFrame(ROWS[5:], MESSAGE_ROW).write.mode("append").parquet(f"{root}/inbox")
    original = live.Snapshots.write

    def failing(self, *args):
        original(self, *args)
        if not failures:
            failures.append(1)
            raise RuntimeError("executor lost")

    monkeypatch.setattr(live.Snapshots, "write", failing)
    store = live.Store(f"{root}/store")
    with pytest.raises(Exception, match="executor lost"):
        live.start_idle_topics(file_source(spark, f"{root}/inbox"), store, availableNow=True).awaitTermination()
    live.start_idle_topics(file_source(spark, f"{root}/inbox"), store, availableNow=True).awaitTermination()
    got = read_batches(spark, store.measure("idle_topics")).orderBy("window_start").collect()
    assert [(r.known, r.active) for r in got if r.active] == [(2, 2), (2, 1), (3, 2), (4, 1), (4, 2), (5, 1)]
    assert len(got) == 60 and {r.idle for r in got[40:59]} == {4}


def test_consumer_lag_of_offsets_read(spark, tmp_path):
    store = deliver(spark, ROWS[:6], [3], str(tmp_path), live.start_offsets)
    everything = spark.createDataFrame([*ROWS, said(0, "z", 99, 40)[:3] + (7, 40, T0, None)], MESSAGE_ROW)
    got = {r.partition: (r.newest, r.committed, r.lag) for r in live.read_consumer_lag(spark, store, everything).collect()}
    assert got == {0: (8, 4, 4), 1: (9, 5, 4), 7: (40, None, 41)}


def test_consumer_lag_before_anything_is_read(spark, tmp_path):
    store = live.Store(f"{tmp_path}/none")
    rows = spark.createDataFrame(ROWS, MESSAGE_ROW)
    assert {r.lag for r in live.read_consumer_lag(spark, store, rows).collect()} == {9, 10}


def test_listener_writes_kafka_offsets(spark, tmp_path):
    store = live.Store(str(tmp_path))
    log = live.OffsetLog(spark, store)

    def progress(batch, *ends):
        sources = [SimpleNamespace(endOffset=e) for e in ends]
        log.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", batchId=batch, sources=sources)))

    progress(0, '{"iot-stream":{"0":3,"1":1}}', '{"logOffset":4}', None, "17", "no json")
    progress(1, '{"iot-stream":{"0":5,"1":10}}')
    progress(1, '{"iot-stream":{"0":5,"1":10}}')
    progress(2, None)
    rows = spark.createDataFrame(ROWS, MESSAGE_ROW)
    got = {r.partition: (r.committed, r.lag) for r in live.read_consumer_lag(spark, store, rows).collect()}
    assert got == {0: (4, 4), 1: (9, 0)}
    assert read_batches(spark, store.measure("offsets")).count() == 4


def test_listener_hears_a_running_query(spark, tmp_path):
    """File sources have no such offsets; the listener takes their events and writes nothing."""
    store = live.Store(f"{tmp_path}/log")
    log = live.OffsetLog(spark, store)
    spark.streams.addListener(log)
    try:
        deliver(spark, ROWS, [], str(tmp_path), live.start_offsets)
    finally:
        spark.streams.removeListener(log)
    assert live.read_consumer_lag(spark, store, spark.createDataFrame(ROWS, MESSAGE_ROW)).where("committed IS NULL").count() == 2


def reading(i, minutes, offset):
    body = {"time": "2024-01-01T00:00:00Z", "device_id": "d", "sequence_id": i, "temperature": 1.0}
    value = json.dumps({"topic": "users/u/devices/d/telemetry", "payload": body}).encode()
    return (None, value, "iot-stream", 0, offset, T0 + timedelta(minutes=minutes), None)


def test_bounded_ingest_forgets(spark, tmp_path):
    """A copy within the delay is dropped, also after a restart; one beyond it is stored again."""
    rows = [reading(1, 0, 0), reading(1, 2, 1), reading(2, 3, 2)]
    rows += [reading(1, 5, 3), reading(3, 40, 4)]  # a restart later; then the state forgets 1 and 2
    rows += [reading(1, 41, 5), reading(3, 45, 6), (None, b"{}", "iot-stream", 0, 7, T0 + timedelta(minutes=46), None)]
    store = deliver(spark, rows, [3, 5], str(tmp_path), live.start_bounded_ingest)
    stored = read_batches(spark, store.bounded).groupBy("sequence_id").count().collect()
    assert {r.sequence_id: r["count"] for r in stored} == {1: 2, 2: 1, 3: 1}


@pytest.mark.parametrize("length,slide", [("1 minute", "5 seconds"), ("1 minute", "7 seconds"), ("1 hour", "20 minutes"), ("30 seconds", "30 seconds")])
def test_panes_add_up_to_windows(spark, length, slide):
    rows = spark.range(400).selectExpr("timestamp_micros(id * id * 1234567) AS ts", "'t' || id % 3 AS topic")
    window = F.window("ts", length, slide).alias("window")
    want = rows.groupBy(window, "topic").count().collect()
    got = metrics.topic_counts(rows, length=length, slide=slide).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    rates = metrics.message_rate(rows, length=length, slide=slide).collect()
    assert sorted((r.window_start, r.messages) for r in rates) == sorted((r.window.start, r["count"]) for r in rows.groupBy(window).count().collect())


def test_dead_letters_are_played_once(spark, tmp_path, monkeypatch):
    def telemetry(i, temperature, device="d"):
        body = {"time": "2024-01-01T00:00:00Z", "device_id": device, "sequence_id": i, "temperature": temperature}
        value = json.dumps({"topic": "users/u/devices/d/telemetry", "payload": body}).encode()
        return (None, value, "iot-stream", 0, i, T0 + timedelta(minutes=i), None)

    rows = [telemetry(0, 1.5), telemetry(1, "2.5"), telemetry(2, "3.5"), telemetry(3, 4.5, ""), telemetry(2, "9.5")]
    store = deliver(spark, rows, [3], str(tmp_path), live.start_ingest)

    def unquoted(messages):
        return messages.withColumn("payload", F.regexp_replace("payload", '"temperature": ?"([0-9.]+)"', '"temperature":$1'))

    def stored():
        return sorted((r.sequence_id, r.temperature) for r in read_telemetry(spark, store.telemetry).collect())

    assert stored() == [(0, 1.5)]
    # a failure after the ledger is written; the run is repeated under its name
    original, failures = live.write_telemetry, []

    def failing(*args):
        failures.append(1)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(live, "write_telemetry", failing)
    with pytest.raises(RuntimeError):
        live.replay_dead_letters(spark, store, "monday", unquoted)
    monkeypatch.setattr(live, "write_telemetry", original)
    assert live.replay_dead_letters(spark, store, "monday", unquoted) == {"played": 4, "stored": 2, "failed": 1}
    assert [s for s, _ in stored()] == [0, 1, 2]
    once = stored()
    assert live.replay_dead_letters(spark, store, "monday", unquoted)["stored"] == 0
    assert live.replay_dead_letters(spark, store, "tuesday", unquoted) == {"played": 0, "stored": 0, "failed": 0}
    assert stored() == once
    # letters that come later are played by the next run
    spark.createDataFrame([telemetry(7, "7.5")], MESSAGE_ROW).write.mode("append").parquet(f"{tmp_path}/inbox")
    live.start_ingest(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    assert live.replay_dead_letters(spark, store, "wednesday", unquoted) == {"played": 1, "stored": 1, "failed": 0}
    assert [s for s, _ in stored()] == [0, 1, 2, 7]


def test_late_messages_are_those_the_rate_drops(spark, tmp_path):
    """Against the windowed query itself, fed the same micro-batches."""
    rows = [said(i, "a", at) for i, at in enumerate([0, 30, 31, 60, 2, 19.9, 20.5, 45, 55, 100, 30, 89.5, 90.5])]
    cuts = [4, 9, 10]
    late = deliver(spark, rows, cuts, f"{tmp_path}/late", live.start_late_messages)
    rate = deliver(spark, rows, cuts, f"{tmp_path}/rate", live.start_message_rate)
    counted = {r.window_start: r.messages for r in live.read_message_rate(spark, rate).collect()}
    dropped = {r.window_start: r.late for r in live.read_late_messages(spark, late).collect()}
    everything = {}
    for row in rows:
        start = row[5].replace(second=0, microsecond=0)
        everything[start] = everything.get(start, 0) + 1
    assert {w: counted.get(w, 0) + dropped.get(w, 0) for w in everything} == everything
    assert sum(dropped.values()) == 6
