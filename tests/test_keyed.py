import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import Row
from pyspark.sql import functions as F

from pulsegrid.functions.topics import control_route, maybe_control
from pulsegrid.schemas import MESSAGE_ROW
from pulsegrid.sources.messages import file_source
from pulsegrid.streaming import keyed, live
from tests.stepwise import fold
from tests.test_live import batch_answer, conversation, deliver, message

COLUMNS = ["event_time", "user_id", "device_id", "rule_id", "alert_type", "message", "value", "status"]
T0 = datetime(2024, 1, 1)


def micros(at):
    return None if at is None else (at - T0) // timedelta(microseconds=1)


def history_of(spark, store):
    return sorted(map(repr, spark.read.parquet(store.history).select(*COLUMNS).collect()))


def test_steps_are_those_of_the_machine():
    rnd = random.Random(4)
    for _ in range(400):
        at, inputs, alert, emitted = T0, [], None, []
        for i in range(rnd.randint(1, 30)):
            at += timedelta(minutes=rnd.choice([0, 1, 5]))
            if rnd.random() < 0.7:
                inputs.append((at, "eval", rnd.random() < 0.6, float(i)))
                alert, status = keyed.evaluated(alert, inputs[-1][2], micros(at), float(i), micros(at))
                if status:
                    emitted.append((at, status, float(i) if status == "Triggered" else None))
            else:
                inputs.append((at, rnd.choice(["SNOOZE", "DISABLE"]), rnd.choice([-2, 0, 3, 10])))
                until = micros(at + timedelta(minutes=inputs[-1][2]))
                alert = keyed.commanded(alert, inputs[-1][1], until)
        want, state = fold(inputs)
        assert emitted == want
        if state is None:
            assert alert is None
        else:
            assert alert == keyed.Alert(state.status, micros(state.start), micros(state.seen), state.value, micros(state.until))


@pytest.mark.parametrize("cuts", [[], [90, 91, 200]])
def test_keyed_state_gives_what_a_batch_gives(spark, cuts, tmp_path):
    rows = conversation()
    store = deliver(spark, rows, cuts, str(tmp_path), keyed.start_keyed_alerts)
    want_history, want_state = batch_answer(spark, rows)
    assert history_of(spark, store) == want_history
    assert sorted(map(repr, keyed.kept_alerts(spark, store).collect())) == want_state


def test_a_new_checkpoint_starts_from_snapshots_or_from_another_one(spark, tmp_path):
    """Snapshot form, then keyed, then keyed again from the state the second one kept."""
    rows = conversation()
    root = str(tmp_path)
    parts = [rows[:80], rows[80:160], rows[160:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, MESSAGE_ROW).write.parquet(f"{root}/inbox-{i}")
    stores = [live.Store(f"{root}/store", f"{root}/checkpoints-{i}") for i in range(3)]
    stream = [file_source(spark, f"{root}/inbox-{i}") for i in range(3)]
    live.start_alerts(stream[0], stores[0], availableNow=True).awaitTermination()
    keyed.start_keyed_alerts(stream[1], stores[1], availableNow=True).awaitTermination()
    seeds = {"configs": keyed.kept_rules(spark, stores[1]), "active": keyed.kept_alerts(spark, stores[1])}
    keyed.start_keyed_alerts(stream[2], stores[2], **seeds, availableNow=True).awaitTermination()
    want_history, want_state = batch_answer(spark, rows)
    assert history_of(spark, stores[2]) == want_history
    assert sorted(map(repr, keyed.kept_alerts(spark, stores[2]).collect())) == want_state


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A failure after the history is written: the micro-batch runs again, from the state before it."""
    rows = conversation()
    root = str(tmp_path)
    spark.createDataFrame(rows[:120], MESSAGE_ROW).write.parquet(f"{root}/inbox")
    store, failures, published = live.Store(f"{root}/store"), [], []

    def publish(messages):
        published.append(messages.count())
        if len(published) == 2 and not failures:
            failures.append(1)
            raise RuntimeError("executor lost")

    def go(**more):
        return keyed.start_keyed_alerts(file_source(spark, f"{root}/inbox"), store, publish=publish, availableNow=True)

    go().awaitTermination()
    spark.createDataFrame(rows[120:], MESSAGE_ROW).write.mode("append").parquet(f"{root}/inbox")
    with pytest.raises(Exception, match="executor lost"):
        go().awaitTermination()
    go().awaitTermination()
    assert failures and published[1] == published[2]
    want_history, want_state = batch_answer(spark, rows)
    assert history_of(spark, store) == want_history
    assert sorted(map(repr, keyed.kept_alerts(spark, store).collect())) == want_state


def test_settings_of_the_session_stay(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in keyed.STATE_SETTINGS}
    rows = [message(0, "users/a/devices/d/telemetry", {"time": "2024-01-01T00:00:00Z", "device_id": "d", "sequence_id": 1, "temperature": 99})]
    store = deliver(spark, rows, [], str(tmp_path), keyed.start_keyed_alerts)
    assert [r.status for r in spark.read.parquet(store.history).collect()] == ["Triggered"]
    assert {name: spark.conf.get(name, None) for name in keyed.STATE_SETTINGS} == before


class Kept(dict):
    """Map state of one key."""

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__


class Handle:
    def __init__(self):
        self.kept = Kept()

    def getMapState(self, name, key, value):
        return self.kept


def test_alerts_of_a_user_are_one_key(spark):
    """Rows of all the user's alerts in one call, in any order: each alert steps by itself."""
    rnd = random.Random(8)
    names = [(f"d{i % 20}", f"r{i // 20}") for i in range(40)]
    columns = ["user_id", "device_id", "rule_id", *keyed.PLACE_COLUMNS, "kind", "pos", "time", "value", "message", "triggered", "action", "until"]
    rows = []
    for i in range(800):
        device, rule = rnd.choice(names)
        place = ("u", device, rule, i // 3, "t", 0, i)
        if rnd.random() < 0.8:
            rows.append((*place, 0, rnd.randint(0, 3), i, float(i), "m", rnd.random() < 0.6, None, None))
        else:
            rows.append((*place, 1, 0, None, None, None, None, rnd.choice(["SNOOZE", "DISABLE"]), i // 3 + rnd.randint(-5, 50)))
    want, state = [], {("d0", "r0"): keyed.Alert("Snoozed", 1, 2, 3.0, 5)}
    for row in rows:
        name, (clock, *_), (time, value, message, triggered, action, until) = row[1:3], row[3:7], row[9:]
        if action is not None:
            state[name] = keyed.commanded(state.get(name), action, until)
            continue
        state[name], status = keyed.evaluated(state.get(name), triggered, time, value, clock)
        if status is not None:
            want.append(("u", *name, time, value, message, status))
    handle, alerts = Handle(), keyed.AlertsOfUser()
    alerts.init(handle)
    first = Row(user_id="u", device_id="d0", rule_id="r0", status="Snoozed", start_time=1, last_seen=2, current_value=3.0, snooze_until=5)
    alerts.handleInitialState(("u",), first, None)
    shuffled = [Row(*columns)(*row) for row in rnd.sample(rows, len(rows))]
    got = list(alerts.handleInputRows(("u",), iter(shuffled), None))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    assert {name: keyed.Alert(*kept) for name, kept in handle.kept.items()} == {n: a for n, a in state.items() if a}
    assert got[0].asDict().keys() == set(keyed._schema(keyed.FOLLOWED).names)


def test_only_messages_that_may_be_orders_are_opened_as_such(spark):
    texts = [
        ('{"topic":"users/a/config","payload":{}}', True), ('{"topic":"users\\/a\\/config","payload":{}}', True),
        ('{"topic":"users/a/confi\\u0067","payload":{}}', True), ('{"topic":"users/a/alerts/manage","payload":{}}', True),
        ('{"topic":"users/a/devices/d/telemetry","payload":{}}', False), ("config", False),
    ]
    rows = spark.createDataFrame([(t.encode(), "iot", w) for t, w in texts], "value binary, topic string, want boolean")
    marked = rows.select("want", maybe_control(F.col("value").cast("string")).alias("got")).collect()
    assert [r.got for r in marked] == [r.want for r in marked] == [w for _, w in texts]
    opened = keyed.decode_envelope(rows).where(control_route(F.col("topic")).isNotNull())
    assert opened.count() == 4
