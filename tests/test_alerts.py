import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts
from pulsegrid.schemas import ACTIVE_ALERT
from tests.stepwise import State, fold

T0 = datetime(2024, 1, 1)
EVALUATION = (
    "user_id string, device_id string, rule_id string, pos int, time timestamp, "
    "sequence_id bigint, value double, message string, triggered boolean"
)
COMMAND = (
    "user_id string, device_id string, rule_id string, action string, duration_minutes bigint, "
    "time timestamp, sequence_id bigint"
)


def random_inputs(rng, n):
    """Inputs a minute apart; some share a time, where commands come last."""
    at, out = T0, []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 1, 2, 7]))
        kind = rng.choices(["eval", "SNOOZE", "DISABLE"], [8, 2, 1])[0]
        if kind == "eval":
            out.append((at, "eval", rng.random() < 0.6, float(i)))
        else:
            out.append((at, kind, rng.choice([-3, 0, 1, 3, 10])))
    ranked = [(item[0], item[1] != "eval", i, item) for i, item in enumerate(out)]
    return [(i, item) for _, _, i, item in sorted(ranked, key=lambda r: r[:3])]


def frames(spark, sequences):
    evaluations, commands = [], []
    for key, inputs in sequences.items():
        for seq, item in inputs:
            if item[1] == "eval":
                evaluations.append(
                    ("u", key, "temperature", 0, item[0], seq, item[3], "hot", item[2])
                )
            else:
                commands.append(("u", key, "temperature", item[1], item[2], item[0], seq))
    return (
        spark.createDataFrame(evaluations, EVALUATION),
        spark.createDataFrame(commands, COMMAND),
    )


def history_rows(df):
    rows = [(r.device_id, r.event_time, r.status, r.value) for r in df.collect()]
    return sorted(rows, key=repr)


def state_rows(df):
    return {
        r.device_id: State(r.status, r.start_time, r.last_seen, r.current_value, r.snooze_until)
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    return {f"d{i}": random_inputs(rng, rng.randint(1, 25)) for i in range(600)}


def expected(sequences, start=None):
    start = start or {}
    history, states = [], {}
    for key, inputs in sequences.items():
        emitted, state = fold([item for _, item in inputs], start.get(key))
        history += [(key, *e) for e in emitted]
        if state is not None:
            states[key] = state
    return sorted(history, key=repr), states


def test_history_and_state_follow_the_machine(spark, sequences):
    evaluations, commands = frames(spark, sequences)
    followed = alerts.follow_alerts(evaluations, commands)
    history, states = expected(sequences)
    got = alerts.make_alert(followed.where("status IS NOT NULL"))
    assert history_rows(got) == history
    assert state_rows(alerts.alert_state_after(followed)) == states


def test_going_on_from_a_snapshot(spark, sequences):
    first = {k: v[: len(v) // 2] for k, v in sequences.items()}
    second = {k: v[len(v) // 2 :] for k, v in sequences.items()}
    _, states = expected(first)
    active = spark.createDataFrame(
        [
            ("u", k, "temperature", s.start, s.seen, s.status, s.until, s.value)
            for k, s in states.items()
        ],
        ACTIVE_ALERT,
    )
    followed = alerts.follow_alerts(*frames(spark, second), active)
    history, after = expected(second, states)
    got = alerts.make_alert(followed.where("status IS NOT NULL"))
    assert history_rows(got) == history
    assert state_rows(alerts.alert_state_after(followed)) == after


STATES = {
    "none": None,
    "Active": State("Active", T0, T0, 1.0),
    "Snoozed, running": State("Snoozed", T0, T0, 1.0, T0 + timedelta(hours=9)),
    "Snoozed, over": State("Snoozed", T0, T0, 1.0, T0 + timedelta(minutes=1)),
    "Snoozed, endless": State("Snoozed", T0, T0, 1.0, None),
    "Disabled": State("Disabled", T0, T0, 1.0),
}
NOW = T0 + timedelta(hours=1)
INPUTS = {
    "true": (NOW, "eval", True, 9.0),
    "false": (NOW, "eval", False, 9.0),
    "snooze": (NOW, "SNOOZE", 5),
    "snooze into the past": (NOW, "SNOOZE", -5),
    "disable": (NOW, "DISABLE", 0),
}


def test_every_state_with_every_input(spark):
    """And with a true and a false evaluation after it."""
    cases, start = {}, {}
    for s, state in STATES.items():
        for i, item in INPUTS.items():
            for later in (True, False):
                key = f"{s}/{i}/{later}"
                cases[key] = [(0, item), (1, (NOW + timedelta(minutes=1), "eval", later, 5.0))]
                start[key] = state
    active = spark.createDataFrame(
        [
            ("u", k, "temperature", s.start, s.seen, s.status, s.until, s.value)
            for k, s in start.items()
            if s is not None
        ],
        ACTIVE_ALERT,
    )
    followed = alerts.follow_alerts(*frames(spark, cases), active)
    history, after = expected(cases, start)
    got = alerts.make_alert(followed.where("status IS NOT NULL"))
    assert history_rows(got) == history
    assert state_rows(alerts.alert_state_after(followed)) == after


def test_hot_groups_give_the_same(spark, sequences):
    """One group holds most rows, over many slices."""
    rng = random.Random(3)
    skewed = dict(list(sequences.items())[:30])
    skewed["hot"] = random_inputs(rng, 4000)
    evaluations, commands = frames(spark, skewed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        followed = alerts.follow_alerts(evaluations, commands)
        history, states = expected(skewed)
        got = alerts.make_alert(followed.where("status IS NOT NULL"))
        assert history_rows(got) == history
        assert state_rows(alerts.alert_state_after(followed)) == states
        nothing = alerts.alert_history_with_commands(evaluations, commands.where("false"))
        assert history_rows(alerts.alert_transitions(evaluations)) == history_rows(nothing)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_without_commands_transitions_equal_history(spark, sequences):
    evaluations, commands = frames(spark, sequences)
    nothing = commands.where(F.lit(False))
    plain = alerts.alert_transitions(evaluations)
    full = alerts.alert_history_with_commands(evaluations, nothing)
    assert history_rows(plain) == history_rows(full)
    state = alerts.alert_state_after(alerts.follow_alerts(evaluations, nothing))
    assert state_rows(state) == state_rows(alerts.active_alerts_asof(evaluations))


def test_two_rules_on_one_key_share_an_alert(spark):
    rows = [
        ("u", "d", "temperature", 0, T0, 1, 60.0, "high", True),
        ("u", "d", "temperature", 1, T0, 1, 60.0, "low", False),
    ]
    got = alerts.alert_transitions(spark.createDataFrame(rows, EVALUATION)).collect()
    assert [(r.status, r.message, r.value) for r in got] == [
        ("Triggered", "high", 60.0),
        ("Resolved", "Alert Resolved", None),
    ]


def test_published_messages(spark):
    rows = [("u7", "d", "temperature", 0, T0, 1, 60.0, "high", True)]
    made = alerts.alert_transitions(spark.createDataFrame(rows, EVALUATION))
    row = alerts.publish_alerts(made).collect()[0]
    assert row.topic == "users/u7/alerts"
    assert '"alert_type":"Rule:temperature"' in row.value and '"value":60.0' in row.value


def test_the_input_is_read_once(spark):
    """Slice ends and windows share one shuffle; rows are counted while they are made."""
    made = spark.sparkContext.accumulator(0)

    def passing(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    plain = spark.range(300).selectExpr(
        "'u' AS user_id", "if(id < 200, 'hot', 'd' || id % 20) AS device_id", "'r' AS rule_id", "0 AS pos",
        "timestamp_seconds(id) AS time", "id AS sequence_id", "1D AS value", "'m' AS message", "id % 3 = 0 AS triggered",
    )
    counted = plain.mapInPandas(passing, plain.schema)
    found = alerts.alert_transitions(counted).count()
    assert made.value == 300 and found == alerts.alert_transitions(plain).count()
    made.value = 0
    assert alerts.active_alerts_asof(counted).count() == alerts.active_alerts_asof(plain).count()
    assert made.value == 300
