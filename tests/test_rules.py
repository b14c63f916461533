from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.rules import rule_holds
from pulsegrid.functions.strict_json import members, parse_document
from pulsegrid.operators import alerts, parse, rules
from pulsegrid.schemas import RULES

T0 = datetime(2024, 1, 1)


def readings(spark, rows):
    """From (topic, payload) pairs."""
    df = spark.createDataFrame(rows, "topic string, payload string")
    return parse.parse_telemetry(df.withColumn("skip_reason", F.lit(None).cast("string")))


def payload(seconds=0, **more):
    import json

    at = (T0 + timedelta(seconds=seconds)).isoformat() + "Z"
    return json.dumps({"time": at, "device_id": "d", "sequence_id": seconds, **more})


def configs(spark, rules_by_user):
    schema = f"user_id string, rules {RULES.simpleString()}"
    return spark.createDataFrame(list(rules_by_user.items()), schema)


def test_two_rules_fire_on_one_message(spark):
    rows = readings(spark, [("users/orchard/telemetry", payload(temperature=-4, battery=3))])
    own = configs(
        spark,
        {
            "orchard": [
                ("temperature", "<", 0.5, "frost"),
                ("battery", "<=", 3.0, "replace cells"),
            ]
        },
    )
    found = alerts.alert_transitions(rules.evaluate_rules(rules.rules_for_user(rows, own)))
    assert {(r.alert_type, r.message) for r in found.collect()} == {
        ("Rule:temperature", "frost"),
        ("Rule:battery", "replace cells"),
    }


def test_who_gets_which_rules(spark):
    rows = readings(
        spark,
        [
            ("users/none/telemetry", payload(temperature=81)),
            ("users/empty/telemetry", payload(temperature=81)),
            ("elsewhere", payload(temperature=81)),
            ("users//telemetry", payload(temperature=81)),
        ],
    )
    ruled = rules.rules_for_user(rows, configs(spark, {"empty": []}))
    got = {r.user_id: r.rules for r in ruled.collect()}
    assert got["none"][0].threshold == 80.0 and got[""][0].threshold == 80.0
    assert got["empty"] == [] and got["unknown"] is None
    assert rules.evaluate_rules(ruled).count() == 2


@pytest.mark.parametrize(
    "operator, below, equal, above",
    [
        (">", False, False, True),
        ("<", True, False, False),
        (">=", False, True, True),
        ("<=", True, True, False),
        ("==", False, True, False),
        ("!=", False, False, False),
    ],
)
def test_operators(spark, operator, below, equal, above):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double").select(
        rule_holds(F.col("v"), F.lit(operator), F.lit(2.0)).alias("r")
    )
    assert [r.r for r in df.collect()] == [below, equal, above]


def test_values_of_extras(spark):
    rows = readings(
        spark,
        [
            (
                "users/u/t",
                payload(
                    temperature=1.5,
                    n=7,
                    s="7",
                    b=True,
                    o={"p": {"q": 4.5}, "l": [1]},
                    user_id="evil",
                ),
            )
        ],
    )
    keys = ["temperature", "battery", "n", "s", "b", "$.o.p.q", "o", "time", "absent"]
    own = configs(spark, {"u": [(k, ">", 0.0, k) for k in keys]})
    found = rules.evaluate_rules(rules.rules_for_user(rows, own)).collect()
    assert {r.rule_id: r.value for r in found} == {"temperature": 1.5, "n": 7.0, "$.o.p.q": 4.5}
    extra = rows.select("user_id", members(parse_document(F.col("extra_data"))).alias("m"))
    row = extra.select("user_id", F.map_keys("m").alias("k")).collect()[0]
    assert row.user_id == "u" and "user_id" in row.k


def test_rules_as_of(spark):
    """A change holds from its own time on; also when one user has all the rows."""
    rows = readings(
        spark,
        [("users/u/t", payload(i, temperature=i)) for i in range(40)] + [("x", payload(3))],
    )
    changes = configs(spark, {"u": [("temperature", ">", 10.0, "a")]}).select(
        "*", F.lit(T0 + timedelta(seconds=10)).alias("time"), F.lit(0).alias("sequence_id")
    )
    changes = changes.unionByName(
        configs(spark, {"u": []}).select(
            "*", F.lit(T0 + timedelta(seconds=30)).alias("time"), F.lit(1).alias("sequence_id")
        )
    )
    got = rules.rules_as_of(rows, changes).collect()
    assert len(got) == 41
    for r in got:
        if r.user_id == "unknown":
            assert r.rules is None
        elif r.sequence_id < 10:
            assert r.rules[0].threshold == 80.0
        elif r.sequence_id < 30:
            assert r.rules[0].threshold == 10.0
        else:
            assert r.rules == []


def test_upsert_keeps_the_newest(spark):
    stored = configs(spark, {"a": [("k", ">", 1.0, "old")], "b": [("k", ">", 2.0, "kept")]})
    updates = configs(spark, {"a": [("k", ">", 3.0, "new")]}).withColumn("at", F.lit(2))
    updates = updates.unionByName(configs(spark, {"a": [("k", ">", 4.0, "x")]}).withColumn("at", F.lit(1)))
    updates = updates.unionByName(configs(spark, {"c": []}).withColumn("at", F.lit(1)))
    got = {r.user_id: r.rules for r in rules.upsert_config(stored, updates, ["at"]).collect()}
    assert got["a"][0].message == "new" and got["b"][0].message == "kept" and got["c"] == []
