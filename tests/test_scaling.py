"""Plans that hold for large tables: no side that grows is sent to every executor, no user is one task's work."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import strict_json
from pulsegrid.operators import alerts, control, envelope, rules, storing
from pulsegrid.plans import fixtures, registry
from pulsegrid.schemas import MESSAGE_ROW, RULES
from pulsegrid.sources.messages import file_source
from pulsegrid.streaming import live

T0 = datetime(2024, 1, 1)


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_and_customers_meet_without_a_broadcast(spark, tmp_path):
    orders = [(i, i % 3, "F" if i % 2 else "O", float(i), T0 + timedelta(days=i)) for i in range(1, 10)]
    orders = spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    customers = spark.createDataFrame([(0, 0.5), (1, 0.0)], "c_custkey long, c_acctbal double")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["custom_predicates"](spark, str(tmp_path))
    assert "Broadcast" not in executed_plan(found)
    delayed = {(f"p{i}", "DeliveryDelay") for i in (1, 3, 7, 9)}
    assert {(r.package_id, r.alert_type) for r in found.collect()} == delayed | {("p3", "PriceCrash")}


def changes_of(spark, rows):
    """From (user, time, sequence number) triples; the threshold tells the change."""
    rows = [(u, t, n, [("k", ">", float(n), "m")]) for u, t, n in rows]
    return spark.createDataFrame(rows, f"user_id string, time timestamp, sequence_id long, rules {RULES.simpleString()}")


def test_rules_as_of_changes_in_many_slices(spark):
    """Hours without a change, many changes at one time, changes without a time, and changes of no user."""
    times = [T0 + timedelta(hours=h, minutes=m) for h in (0, 1, 5, 5, 30) for m in (0, 20, 20, 59)]
    changes = [("u", t, n) for n, t in enumerate(times)] + [("v", None, 90), ("v", T0, 91), (None, T0, 92), ("w", None, 93)]
    at = sorted({t + timedelta(seconds=s) for t in times for s in (-1, 0, 1)})
    rows = [(u, t) for u in ("u", "v", "w", "x", None) for t in at]
    readings = spark.createDataFrame(rows, "rule_user string, time timestamp").withColumn("sequence_id", F.lit(0).cast("long"))
    got = rules.rules_as_of(readings, changes_of(spark, changes)).collect()
    assert len(got) == len(rows)
    for r in got:
        held = [(t or datetime.min, n) for u, t, n in changes if u is not None and u == r.rule_user and (t is None or t <= r.time)]
        want = None if r.rule_user is None else max(held)[1] if held else 80.0
        assert (r.rules[0].threshold if r.rules else None) == want


def test_changes_of_one_user_are_not_ordered_in_one_task(spark):
    changes = changes_of(spark, [("u", T0 + timedelta(hours=h), h) for h in range(50)])
    plan = rules.rule_intervals(changes, "time", ["sequence_id"], False)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window .*, \[user_id#\d+, _slice#\d+L?\], \[time#", plan)
    assert not re.search(r"Window .*, \[user_id#\d+\], \[time#", plan)


READING = "time timestamp, user_id string, device_id string, sequence_id long, temperature double, partition int, offset long"


def test_first_rows_are_found_without_a_broadcast(spark):
    rows = spark.createDataFrame([(T0, "u", "d", i % 5, float(i), 0, i) for i in range(20)], READING)
    firsts = storing.dedupe_first_wins(rows)
    assert "Broadcast" not in executed_plan(firsts)
    assert {(r.sequence_id, r.offset) for r in firsts.collect()} == {(i, i) for i in range(5)}


def test_what_is_stored_is_not_broadcast(spark):
    rows = spark.createDataFrame([(T0, "u", "d", i, float(i), 0, i) for i in range(9)], READING)
    new = storing.anti_join_existing(rows, rows.where("sequence_id < 6"))
    assert "Broadcast" not in executed_plan(new)
    assert {r.sequence_id for r in new.collect()} == {6, 7, 8}


def test_late_copies_come_from_one_pass(spark):
    rows = [(T0, "u", "d", i, float(i) if i else None, 0, i) for i in range(21)]
    both = fixtures.with_copies(spark.createDataFrame(rows, READING))
    assert "Union" not in executed_plan(both)
    late = [(i, None if i == 0 else i + 1.0, i + 1_000_000_000) for i in (0, 10, 20)]
    want = [(r[3], r[4], r[6]) for r in rows] + late
    assert sorted(((r.sequence_id, r.temperature, r.offset) for r in both.collect()), key=str) == sorted(want, key=str)


def message(i, topic, payload):
    value = json.dumps({"topic": topic, "payload": payload}).encode()
    return (None, value, "iot-stream", 0, i, T0 + timedelta(minutes=i), None)


def test_inputs_of_a_micro_batch_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Rule changes and alert inputs go through one shuffle each, and the tables of the micro-batch are removed."""
    rule = {"key": "temperature", "operator": ">", "threshold": 20, "message": "m"}
    rows = [message(0, "users/u/config", {"rules": [rule]}), message(1, "users/v/config", {"rules": [rule]})]
    command = {"device_id": "d", "rule_id": "temperature", "action": "DISABLE"}
    for i in range(2, 20):
        body = {"time": (T0 + timedelta(minutes=i)).isoformat() + "Z", "device_id": "d", "sequence_id": i, "temperature": 10.0 * (i % 4)}
        rows.append(message(i, f"users/{'uv'[i % 2]}/devices/d/telemetry", body))
    rows.append(message(20, "users/u/alerts/manage", command))
    spark.createDataFrame(rows, MESSAGE_ROW).write.parquet(f"{tmp_path}/inbox")
    plans = {}

    def seen(module, name):
        real = getattr(module, name)

        def run(*args, **kwargs):
            found = real(*args, **kwargs)
            plans[name] = executed_plan(found)
            return found

        monkeypatch.setattr(module, name, run)

    seen(rules, "rules_as_of")
    seen(alerts, "follow_alerts")
    store = live.Store(f"{tmp_path}/store")
    live.start_alerts(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    assert set(plans) == {"rules_as_of", "follow_alerts"}
    for plan in plans.values():
        final = plan.split("== Initial Plan ==")[0]
        assert len(set(re.findall(r"REPARTITION_BY_COL, \[plan_id=(\d+)\]", final))) == 1
    assert spark.read.parquet(store.history).count() > 0
    assert not (tmp_path / "store" / "scratch").exists() or not any((tmp_path / "store" / "scratch").iterdir())


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_member_of_a_rule_is_looked_up_once(spark):
    readings = spark.createDataFrame(
        [("u", "d", T0, 1, None, None, '{"a": {"b": 3}, "c": 9}')],
        "user_id string, device_id string, time timestamp, sequence_id long, temperature double, battery int, extra_data string",
    )
    listed = [("$.a.b", ">", 2.0, "m"), ("c", "<", 2.0, "m"), ("none", ">", 0.0, "m"), ("$.a[", ">", 0.0, "m"), ("battery", ">", 0.0, "m")]
    listed = spark.createDataFrame([(listed,)], f"rules {RULES.simpleString()}")
    extras = strict_json.members(strict_json.parse_document(F.col("extra_data")))
    found = rules.evaluate_rules(readings.crossJoin(listed).withColumn("extras", extras))
    assert optimized(found).count("RLIKE") - optimized(readings.select(extras)).count("RLIKE") <= 2  # its path, its type
    assert {(r.rule_id, r.value, r.triggered) for r in found.collect()} == {("$.a.b", 3.0, True), ("c", 9.0, False)}


def test_rule_lists_are_opened_once(spark):
    good = '{"rules":[{"key":"a","operator":">","threshold":1,"message":"m"}]}'
    texts = [good, '{"rules":[{"key":"a"}]}', '{"rules":[7]}', '{"rules":7}', "{}", "[", '{"rules":[]}']
    routed = spark.createDataFrame([("users/u/config", t, "config") for t in texts], "topic string, payload string, route string")
    parsed = control.parse_config_update(routed)
    valid = parsed.where("error IS NULL").select("user_id", "rules")
    assert optimized(valid).count("ArrayType(VariantType") == 1
    got = {r.payload: (r.error, r.rules and [tuple(x) for x in r.rules]) for r in parsed.collect()}
    bad = ("bad_config", None)
    assert got == dict(zip(texts, [(None, [("a", ">", 1.0, "m")]), bad, bad, bad, (None, []), bad, (None, [])], strict=True))


def test_the_type_of_a_payload_is_worked_out_once(spark):
    texts = ['{"topic":"t","payload":{"a":1}}', '{"topic":"t","payload":null}', '{"topic":"t","payload":"[1]"}', '{"topic":"t","payload":"x"}']
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    decoded = envelope.decode_envelope(rows)
    assert optimized(decoded).count("schemaOfVariant") == 2  # topic and payload
    got = [(r.payload, r.document) for r in decoded.select("payload", F.to_json("document").alias("document")).collect()]
    assert got == [('{"a":1}', '{"a":1}'), ("null", "null"), ("[1]", "[1]"), ("x", None)]


@pytest.mark.parametrize("text", ["1e999", "1E+308", "9" * 200, "1" * 199, "e999", "1e99", "1 e999", "", "12e+1000"])
def test_texts_with_huge_numbers(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(strict_json.HUGE_NUMBER)).first()[0]
    assert found == bool(re.search(r"[0-9][eE]\+?[0-9]{3}|[0-9]{200}", text))


def test_ingest_opens_each_message_once(spark, tmp_path, monkeypatch):
    """Skipped messages are counted from the rows that are kept, which hold them beside the readings."""
    rows = [message(i, "users/u/devices/d/telemetry", {"bad": i}) for i in range(3)]
    rows += [message(3, "users/u/config", {"rules": []}), (None, b"no envelope", "iot-stream", 0, 4, T0, None)]
    spark.createDataFrame(rows, MESSAGE_ROW).write.parquet(f"{tmp_path}/inbox")
    plans, real = [], live.skipped_messages
    monkeypatch.setattr(live, "skipped_messages", lambda df: plans.append(executed_plan(real(df))) or real(df))
    store = live.Store(f"{tmp_path}/store")
    live.start_ingest(file_source(spark, f"{tmp_path}/inbox"), store, availableNow=True).awaitTermination()
    assert plans and all("InMemoryTableScan" in p for p in plans)
    assert [tuple(r) for r in spark.read.parquet(store.skipped).select("reason", "n").collect()] == [("not_an_envelope", 1)]
    assert spark.read.parquet(store.dead_letters).count() == 3
