from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import topics
from pulsegrid.functions.strict_json import as_time, parse_document, quoted
from pulsegrid.functions.trace import trace_context
from pulsegrid.operators import control, dead_letter, envelope, parse
from pulsegrid.operators.rules import load_rules

GOOD = '{"battery":61,"temperature":-3.25,"sequence_id":40712,"device_id":"mast-7","time":"2021-06-30T05:09:31Z"}'
TOPIC = "users/u1/devices/d2/telemetry"


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


DOCUMENTS = {
    '{"a":1}': True,
    ' {"a":[1,{"b":"]"}]} ': True,
    '"text"': True,
    "null": True,
    '{"a":1} junk': False,
    '{"a":1}}': False,
    '{"a":1}]': False,
    '{"a":1}],[{"b":2}': False,
    '{"a":1},{"b":2}': False,
    '1,"w":[2]': False,
    '{"a":[1]},"x":[2]': False,
    "{'a':1}": False,
    '{"a":1,}': False,
    '{"a":NaN}': False,
    '{"a":01}': False,
    "": False,
    "  ": False,
}


def test_documents(spark):
    df = texts(spark, DOCUMENTS).select("t", parse_document(F.col("t")).isNotNull().alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == DOCUMENTS


TIMES = {
    "2023-10-01T12:00:00Z": datetime(2023, 10, 1, 12),
    "2023-10-01T12:00:00.5+02:00": datetime(2023, 10, 1, 10, 0, 0, 500000),
    "2023-10-01T12:00:00,25Z": datetime(2023, 10, 1, 12, 0, 0, 250000),
    "2023-10-01T12:00:00.123456789+05": datetime(2023, 10, 1, 7, 0, 0, 123456),
    "2023-10-01T12:00:00-0530": datetime(2023, 10, 1, 17, 30),
    "2023-10-01T12:00:00": None,
    "2023-10-01": None,
    "2023-13-01T12:00:00Z": None,
    "x2023-10-01T12:00:00Z": None,
}


def test_times(spark):
    document = parse_document(F.concat(F.lit('"'), "t", F.lit('"')))
    df = texts(spark, TIMES).select("t", as_time(document).cast("timestamp_ntz").alias("at"))
    assert {r.t: r["at"] for r in df.collect()} == TIMES


def test_quoted(spark):
    odd = 'a"b\\c\ndé'
    row = texts(spark, [odd]).select(
        F.get_json_object(F.concat(F.lit('{"x":'), quoted(F.col("t")), F.lit("}")), "$.x")
    )
    assert row.collect()[0][0] == odd


PAYLOADS = {
    GOOD: None,
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1}': None,
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"temperature":null}': None,
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"temperature":5}': None,
    '{"time":"2023-10-01T12:00:00Z","device_id":"","sequence_id":1}': "Empty device_id",
    '{"reading":[]}': "missing field `time`",
    '{"time":"2023-10-01T12:00:00Z","device_id":7,"sequence_id":1}': "`device_id` of type BIGINT",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":"1"}': "`sequence_id`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1.0}': "`sequence_id`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":null}': "of type VOID",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"temperature":"25"}': "`temperature`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"temperature":"NaN"}': "`temperature`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"temperature":true}': "`temperature`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"battery":1.5}': "`battery`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"battery":25.0}': "`battery`",
    '{"time":"2023-10-01T12:00:00Z","device_id":"d","sequence_id":1,"battery":3000000000}': "`battery`",
    '{"time":"2023-10-01","device_id":"d","sequence_id":1}': "`time`",
    "[1]": "not an object",
    '{"time":': "not an object",
}


@pytest.mark.parametrize("as_string", [False, True])
def test_readings_through_the_envelope(spark, as_string):
    """As an object payload and as a JSON string payload."""
    body = quoted(F.col("t")) if as_string else F.col("t")
    rows = texts(spark, PAYLOADS).select(
        "i",
        "t",
        F.concat(F.lit(f'{{"topic":"{TOPIC}","payload":'), body, F.lit("}")).alias("value"),
    )
    readings = parse.parse_telemetry(envelope.decode_envelope(rows))
    found = {r.t: r for r in readings.collect()}
    for text, problem in PAYLOADS.items():
        if not as_string and problem == "not an object" and text.startswith("{"):
            assert text not in found  # a broken object breaks its envelope
            continue
        row = found[text]
        assert row.user_id == "u1"
        assert (row.error is None) == (problem is None), (text, row.error)
        if problem:
            assert problem in row.error
    good = found[GOOD]
    assert (good.device_id, good.sequence_id, good.temperature, good.battery) == (
        "mast-7",
        40712,
        -3.25,
        61,
    )
    assert good.extra_data == "{}"


def test_envelopes(spark):
    cases = {
        '{"topic":"a","payload":{"x":25.0,"y":[1]}}': ("a", '{"x":25.0,"y":[1]}'),
        '{"topic":"a","payload":"raw {"}': ("a", "raw {"),
        '{"topic":"a","payload":null}': ("a", "null"),
        '{"topic":"a","payload":7,"more":1}': ("a", "7"),
        '{"topic":7,"payload":1}': (None, None),
        '{"payload":1}': (None, None),
        '{"topic":"a"}': (None, None),
        '{"topic":"a","payload":1} x': (None, None),
        "[]": (None, None),
    }
    rows = texts(spark, cases).select("i", F.col("t").alias("value"))
    decoded = envelope.decode_envelope(rows).join(texts(spark, cases), "i").collect()
    assert {r.t: (r.topic, r.payload) for r in decoded} == cases
    assert all((r.skip_reason is None) == (cases[r.t][0] is not None) for r in decoded)


def test_wrapping_and_opening_again(spark):
    raw = spark.createDataFrame(
        [("t/1", ' {"a":25.0} '), ("t/2", "oops"), ("t/3", "{}"), ("t/4", '"s"')],
        "topic string, message string",
    )
    plain = envelope.bridge_wrap(raw)
    back = envelope.decode_envelope(plain.where("error IS NULL").select("value"))
    assert {(r.topic, r.payload) for r in back.collect()} == {
        ("t/1", '{"a":25.0}'),
        ("t/3", "{}"),
        ("t/4", "s"),
    }
    enriched = envelope.bridge_wrap_enriched(raw, now=F.timestamp_millis(F.lit(1234))).cache()
    assert {r.topic for r in enriched.where("error IS NOT NULL").collect()} == {"t/2", "t/4"}
    again = envelope.decode_envelope(enriched.where("error IS NULL").select("value", "headers"))
    rows = {r.topic: r for r in again.collect()}
    assert rows["t/1"].payload == '{"a":25.0,"ingest_timestamp":1234}'
    assert rows["t/3"].payload == '{"ingest_timestamp":1234}'
    assert rows["t/1"].traceparent != rows["t/3"].traceparent


def test_dead_letters_play_back_the_same_text(spark):
    odd = ['{"a":1} é中 "x"', "", "x" * 500, "null"]
    rejected = spark.createDataFrame(
        [("users/u/x", t, "Invalid JSON: x") for t in odd], "topic string, payload string, error string"
    )
    back = dead_letter.replay_dead_letter(dead_letter.to_dead_letter(rejected))
    assert sorted(r.payload for r in back.collect()) == sorted(odd)
    value = dead_letter.to_dead_letter(rejected).collect()[2].value
    assert "\\r" not in value and "\\n" not in value


USERS = {
    "users/a/devices/d/telemetry": "a",
    "users/a": "a",
    "users/a/users/b": "b",
    "x/y/users/c": "c",
    "x/y/users/c/d": "c",
    "x/users/c": None,
    "users//telemetry": "",
    "users": None,
    "": None,
}


def test_user_of_topic(spark):
    df = texts(spark, USERS).select("t", topics.user_id_from_topic(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == USERS


@pytest.mark.parametrize(
    "topic_filter, topic, fits",
    [
        ("users/+/config", "users/a/config", True),
        ("users/+/config", "users//config", True),
        ("users/+/config", "users/a/b/config", False),
        ("users/+/config", "users/a/config\n", False),
        ("users/#", "users", True),
        ("users/#", "users/a/b", True),
        ("users/#", "users2/a", False),
        ("#", "anything/at all", True),
        ("a.b/+", "axb/c", False),
        ("$SYS/#", "$SYS/x", True),
    ],
)
def test_filters(spark, topic_filter, topic, fits):
    row = spark.createDataFrame([(topic, topic_filter)], "t string, f string").select(
        topics.match_topic_filter(F.col("t"), topic_filter).alias("known"),
        topics.match_topic_levels(F.col("t"), F.col("f"), {}).alias("column"),
    )
    assert tuple(row.collect()[0]) == (fits, fits)


def test_placeholders_are_no_wildcards(spark):
    rows = spark.createDataFrame(
        [("users/+/x", "+", True), ("users/a/x", "+", False), ("users/a/x", "a", True)],
        "t string, u string, want boolean",
    )
    got = topics.match_topic_levels(F.col("t"), F.lit("users/%u/x"), {"%u": F.col("u")})
    assert all(r.got == r.want for r in rows.withColumn("got", got).collect())


def test_trace_context(spark):
    good = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"
    cases = {
        good: "4bf92f3577b34da6a3ce929d0e0e4736",
        good.upper(): None,
        good.replace("4bf92f3577b34da6a3ce929d0e0e4736", "0" * 32): None,
        "ff" + good[2:]: None,
        good + "-x": None,
        "": None,
    }
    df = texts(spark, cases).select("t", trace_context(F.col("t"))["trace_id"].alias("id"))
    assert {r.t: r.id for r in df.collect()} == cases


def test_control_messages(spark):
    rule = '{"key":"temperature","operator":">","threshold":50,"message":"m"}'
    rows = spark.createDataFrame(
        [
            ("users/u/config", f'{{"rules":[{rule}]}}', None, 1),
            ("users/u/config", "{}", None, 0),
            ("users/u/config", '{"rules":null}', "bad_config", None),
            ("users/u/config", '{"rules":[{"key":"x"}]}', "bad_config", None),
            ("users/u/config", "oops", "bad_config", None),
            ("users/u/other/config", "{}", "not_a_config_topic", 0),
            ("users/u/telemetry", "{}", "unrouted", None),
        ],
        "topic string, payload string, want string, n int",
    )
    got = control.parse_config_update(control.route_control(rows)).collect()
    assert len(got) == 6
    for r in got:
        assert r.error == r.want, r
        assert (None if r.rules is None else len(r.rules)) == r.n, r


def test_commands(spark):
    rows = spark.createDataFrame(
        [
            ('{"device_id":"d","rule_id":"r","action":"SNOOZE"}', None, 30),
            ('{"device_id":"d","rule_id":"r","action":"SNOOZE","duration_minutes":null}', None, 30),
            ('{"device_id":"d","rule_id":"r","action":"SNOOZE","duration_minutes":-5}', None, -5),
            ('{"device_id":"d","rule_id":"r","action":"SNOOZE","duration_minutes":1.5}', "bad_command", None),
            ('{"device_id":"d","rule_id":"r","action":"snooze"}', "unknown_action", 30),
            ('{"device_id":"d","action":"DISABLE"}', "bad_command", 30),
            ("oops", "bad_command", 30),
        ],
        "payload string, want string, minutes bigint",
    ).withColumn("topic", F.lit("users/u/alerts/manage"))
    for r in control.parse_command(control.route_control(rows)).collect():
        assert (r.error, r.duration_minutes) == (r.want, r.minutes), r


def test_stored_rules_that_cannot_be_read_are_no_rules(spark):
    stored = spark.createDataFrame(
        [("a", "[]"), ("b", "oops"), ("c", None), ("d", '[{"key":"k","operator":">","threshold":1,"message":"m"}]')],
        "user_id string, rules string",
    )
    assert {r.user_id: len(r.rules) for r in load_rules(stored).collect()} == {
        "a": 0, "b": 0, "c": 0, "d": 1,
    }


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a":"Infinity","a":"x","b":1e999}', False),
        ('{"note":"\\u0049nfinity","x":1e100}', True),
        ('{"a":1e999,"a":1}', False),
        ('{"a":"1e999"}', True),
        ('{"a":"\\"1e999","b":[-1e400]}', False),
        ('{"a":"\\\\","b":"1e999"}', True),
        ('{"1e999":0}', True),
        ('{"a":1e-999}', True),
        ('{"a":1E+308,"b":1e0308}', True),
        ('{"a":1e309}', False),
        ('{"a":' + "9" * 250 + "e99}", False),
        ('{"a":' + "9" * 250 + "}", True),
        ('{"a":0.' + "9" * 350 + "}", True),
        ('{"a":"' + '\\"' * 20_000 + '","b":1e999}', False),
    ],
)
def test_numbers_out_of_range(spark, text, valid):
    row = spark.createDataFrame([(text,)], "t string").select(parse_document(F.col("t")).isNotNull().alias("ok"))
    assert row.first().ok == valid
