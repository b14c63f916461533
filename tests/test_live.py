import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts, control, envelope, parse, rules
from pulsegrid.schemas import MESSAGE_ROW
from pulsegrid.sources.messages import file_source
from pulsegrid.sources.tables import read_telemetry
from pulsegrid.streaming import live

T0 = datetime(2024, 1, 1)


def message(i, topic, payload):
    value = json.dumps({"topic": topic, "payload": payload}).encode()
    return (None, value, "iot-stream", 0, i, T0 + timedelta(minutes=i), None)


def conversation():
    """Telemetry of two devices, rule changes, commands, faults and copies."""
    rng = random.Random(11)
    out = []
    for i in range(240):
        user, device = rng.choice(["a", "b"]), rng.choice(["d1", "d2"])
        kind = rng.random()
        if kind < 0.05:
            rule = {"key": "temperature", "operator": ">", "threshold": rng.choice([20, 50, 80]), "message": "m"}
            out.append(message(i, f"users/{user}/config", {"rules": [rule]}))
        elif kind < 0.2:
            body = {"device_id": device, "rule_id": "temperature", "action": rng.choice(["SNOOZE", "DISABLE", "huh"])}
            if rng.random() < 0.7:
                body["duration_minutes"] = rng.choice([1, 10, 40])
            out.append(message(i, f"users/{user}/alerts/manage", body))
        elif kind < 0.25:
            out.append(message(i, f"users/{user}/devices/{device}/telemetry", {"bad": i}))
        else:
            at = (T0 + timedelta(minutes=i - i % 7)).isoformat() + "Z"
            body = {"time": at, "device_id": device, "sequence_id": i // 2, "temperature": rng.choice([10.0, 30.5, 60.0, 90.0])}
            out.append(message(i, f"users/{user}/devices/{device}/telemetry", body))
    out.append((None, b"no envelope", "iot-stream", 0, 240, T0 + timedelta(minutes=240), None))
    return out


@pytest.fixture(scope="module")
def rows():
    return conversation()


def deliver(spark, rows, cuts, root, start):
    """Deliver the rows in parts, with a restart from the checkpoint before each."""
    store = live.Store(f"{root}/store")
    bounds = [0, *cuts, len(rows)]
    for low, high in zip(bounds, bounds[1:]):
        part = spark.createDataFrame(rows[low:high], MESSAGE_ROW)
        part.write.mode("append").parquet(f"{root}/inbox")
        start(file_source(spark, f"{root}/inbox"), store, availableNow=True).awaitTermination()
    return store


def batch_answer(spark, rows):
    decoded = envelope.decode_envelope(spark.createDataFrame(rows, MESSAGE_ROW))
    routed = control.route_control(decoded)
    updates = control.parse_config_update(routed).where("error IS NULL")
    updates = updates.select("user_id", "rules", "timestamp", F.col("offset").alias("sequence_id"))
    commands = control.parse_command(routed).where("error IS NULL").withColumn("sequence_id", F.col("offset"))
    readings = parse.parse_telemetry(decoded.where(~F.col("topic").rlike("(config|manage)$")))
    readings = readings.where("error IS NULL").withColumn("sequence_id", F.col("offset"))
    ruled = rules.rules_as_of(readings, updates, at="timestamp")
    evaluated = rules.evaluate_rules(ruled, carry=("timestamp",))
    followed = alerts.follow_alerts(evaluated, commands, clock="timestamp")
    history = alerts.make_alert(followed.where("status IS NOT NULL"))
    return sorted(map(repr, history.collect())), sorted(map(repr, alerts.alert_state_after(followed).collect()))


@pytest.mark.parametrize("cuts", [[], [100], [1, 2, 90, 91, 200]])
def test_streams_give_what_a_batch_gives(spark, rows, cuts, tmp_path):
    store = deliver(spark, rows, cuts, str(tmp_path), live.start_alerts)
    columns = ["event_time", "user_id", "device_id", "rule_id", "alert_type", "message", "value", "status"]
    history = spark.read.parquet(store.history).select(*columns)
    want_history, want_state = batch_answer(spark, rows)
    assert len(want_history) > 20 and want_state
    assert sorted(map(repr, history.collect())) == want_history
    assert sorted(map(repr, store.active(spark).latest().collect())) == want_state


def test_repeated_batch_changes_nothing(spark, rows, tmp_path, monkeypatch):
    """A failure after the outputs are written: the micro-batch runs again."""
    half = 120
    deliver(spark, rows[:half], [], str(tmp_path), live.start_alerts)
    spark.createDataFrame(rows[half:], MESSAGE_ROW).write.mode("append").parquet(f"{tmp_path}/inbox")
    failures = []
    original = live.Snapshots.write

    def failing(self, *args):
        original(self, *args)
        if not failures:
            failures.append(args)
            raise RuntimeError("executor lost")

    monkeypatch.setattr(live.Snapshots, "write", failing)
    store = live.Store(f"{tmp_path}/store")
    broken = live.start_alerts(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True)
    with pytest.raises(Exception, match="executor lost"):
        broken.awaitTermination()
    assert failures
    live.start_alerts(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    columns = ["event_time", "user_id", "device_id", "rule_id", "alert_type", "message", "value", "status"]
    history = spark.read.parquet(store.history).select(*columns)
    want_history, want_state = batch_answer(spark, rows)
    assert sorted(map(repr, history.collect())) == want_history
    assert sorted(map(repr, store.active(spark).latest().collect())) == want_state


def test_ingest_stores_everything_once(spark, rows, tmp_path):
    stores = [
        deliver(spark, rows, cuts, f"{tmp_path}/{i}", live.start_ingest)
        for i, cuts in enumerate([[], [50, 150]])
    ]
    tables = [sorted(map(repr, read_telemetry(spark, s.telemetry).collect())) for s in stores]
    assert tables[0] == tables[1] and len(tables[0]) == len(set(tables[0]))
    telemetry = [json.loads(r[1]) for r in rows[:-1]]
    good = {
        (p["payload"]["time"], p["topic"].split("/")[1], p["payload"]["device_id"], p["payload"]["sequence_id"])
        for p in telemetry
        if p["topic"].endswith("telemetry") and "time" in p["payload"]
    }
    assert len(tables[0]) == len(good)
    bad = sum("bad" in p["payload"] for p in telemetry)
    assert spark.read.parquet(stores[1].dead_letters).count() == bad
    skipped = spark.read.parquet(stores[1].skipped).agg(F.sum("n")).collect()[0][0]
    assert skipped == 1


def test_published_alerts(spark, rows, tmp_path):
    seen = []

    def start(messages, store, **trigger):
        return live.start_alerts(messages, store, publish=lambda m: seen.extend(m.collect()), **trigger)

    store = deliver(spark, rows, [], str(tmp_path), start)
    assert len(seen) == spark.read.parquet(store.history).count()
    assert {r.topic for r in seen} == {"users/a/alerts", "users/b/alerts"}


def test_complete_windows_are_written_once(spark, rows, tmp_path):
    def start(messages, store, **trigger):
        return live.start_complete_windows(
            messages, store, "active_topics", "10 minutes", "10 minutes", **trigger
        )

    store = deliver(spark, rows, [80, 160], str(tmp_path), start)
    got = {r.window_start: r.active for r in spark.read.parquet(store.measure("active_topics")).collect()}
    want = {}
    for row in rows[:-1]:
        want.setdefault(row[5] - timedelta(minutes=row[5].minute % 10), set()).add(json.loads(row[1])["topic"])
    last = rows[-2][5]
    want = {k: len(v) for k, v in want.items() if k + timedelta(minutes=20) <= last}
    assert got == want
    assert spark.read.parquet(store.measure("active_topics")).count() == len(want)


def test_kafka_needs_its_connector(spark):
    from pulsegrid.sources.messages import kafka_source

    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_source(spark, "localhost:9092", "iot-stream", max_offsets=10)


def test_hostile_messages_stop_nothing(spark, tmp_path):
    """Malformed rule keys, endless durations and numbers out of range beside a user like any other."""
    keys = ["$.o[", "$.o..a", "$.o['a", "$.o.", "$.o[x]", "$.o[99999999999]", "$.o. ", "$.", "$", ""]
    bad = [{"key": k, "operator": ">", "threshold": 0, "message": "m"} for k in keys]
    good = [{"key": "$.o.a", "operator": ">", "threshold": 5, "message": "deep"}]
    at = T0.isoformat() + "Z"

    def reading(i, user, **more):
        body = {"time": at, "device_id": "d", "sequence_id": i, "o": {"a": 9}, **more}
        return message(i, f"users/{user}/telemetry", body)

    def snooze(i, minutes):
        body = {"device_id": "d", "rule_id": "$.o.a", "action": "SNOOZE", "duration_minutes": minutes}
        return message(i, "users/calm/alerts/manage", body)

    rows = [
        message(0, "users/wild/config", {"rules": bad}),
        message(1, "users/calm/config", {"rules": good}),
        reading(2, "wild"),
        reading(3, "calm"),
        snooze(4, -(2**63)),
        reading(5, "calm"),
        snooze(6, 2**63 - 1),
        reading(7, "calm"),
        (None, b'{"topic":"users/calm/telemetry","payload":"{\\"temperature\\":1e999}"}', "iot-stream", 0, 8, T0, None),
        (None, b'{"topic":"users/calm/telemetry","payload":{"temperature":1e999}}', "iot-stream", 0, 9, T0, None),
    ]
    store = deliver(spark, rows, [5], str(tmp_path), live.start_alerts)
    history = spark.read.parquet(store.history)
    assert sorted((r.user_id, r.status) for r in history.collect()) == [("calm", "Triggered"), ("calm", "Triggered")]
    state = store.active(spark).latest().collect()
    assert [(r.status, r.snooze_until.year) for r in state] == [("Snoozed", 9999)]
    live.start_ingest(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    assert spark.read.parquet(store.dead_letters).count() == 1
    assert live.read_write_stats(spark, store).agg({"written": "sum"}).first()[0] == 4


def test_one_reading_rewrites_one_bucket(spark, tmp_path):
    store = live.Store(f"{tmp_path}/store")
    alert = "'d' || id AS device_id, 'temperature' AS rule_id, TIMESTAMP '2024-01-01' AS start_time"
    many = spark.range(10_000).selectExpr(
        "'u' AS user_id", alert.split(", 'temperature'")[0], "'temperature' AS rule_id", "TIMESTAMP '2024-01-01' AS start_time",
        "TIMESTAMP '2024-01-01' AS last_seen", "'Active' AS status", "CAST(NULL AS TIMESTAMP) AS snooze_until", "90D AS current_value",
    )
    store.seed(active=many, configs=spark.createDataFrame([], live.CONFIGS))
    with pytest.raises(ValueError, match="already"):
        store.seed(active=many)
    before = store.active(spark)._versions()[-1]["parts"]
    body = {"time": T0.isoformat() + "Z", "device_id": "d77", "sequence_id": 1, "temperature": 10.0}
    rows = spark.createDataFrame([message(1, "users/u/telemetry", body)], MESSAGE_ROW)
    rows.write.parquet(f"{tmp_path}/inbox")
    live.start_alerts(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    after = store.active(spark)._versions()[-1]["parts"]
    assert sum(before.get(b) != after.get(b) for b in set(before) | set(after)) == 1
    assert store.active(spark).latest().count() == 9_999


def test_superseded_versions_go_and_uncommitted_rows_do_not_count(spark, tmp_path):
    table = live.Store(str(tmp_path)).configs(spark)
    for batch in range(8):
        rows = spark.createDataFrame([("a", [(f"k{batch}", ">", 1.0, "m")])], live.CONFIGS)
        base = table.before("q", batch)
        table.write(rows, base, table.touched(rows), "q", batch)
    assert len(table._versions()) == table.KEPT == len(list((tmp_path / "user_configs/rows").iterdir()))
    assert table.latest().collect()[0].rules[0].key == "k7"
    assert table.read(table.before("q", 7)).collect()[0].rules[0].key == "k6"
    assert table.read(table.before("other", 0)).collect()[0].rules[0].key == "k7"
    stray = tmp_path / "user_configs/rows/000000000099-x/bucket=0"
    stray.mkdir(parents=True)
    assert table.latest().count() == 1
