"""Test messages derived from the given tables (whole tables, row by row).

Every row of ``events`` becomes one telemetry message; some carry a fault chosen by the id, so that
every failure class occurs. Rules, commands, offsets and an access log derive from it too.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.strict_json import quoted
from pulsegrid.operators.envelope import decode_envelope
from pulsegrid.operators.once import computed_once
from pulsegrid.schemas import DomainSpec, Field
from pulsegrid.operators.parse import parse_telemetry, split_accept_reject
from pulsegrid.session import configure
from pulsegrid.sources.messages import spread

STREAM = "iot-stream"
CONTROL = "iot-control"
PARTITIONS = 4
CHANGE_AT = "2024-01-15 00:00:00"
CONFIG_AT = "2023-12-31 00:00:00"

# Rules per user group, the group being user_id % 5; group 0 has no stored rules.
RULES_JSON = {
    1: '{"rules":[]}',
    2: '{"rules":[{"key":"temperature","operator":">","threshold":100,"message":"Very hot"},'
    '{"key":"battery","operator":"<","threshold":20,"message":"Battery low"}]}',
    3: '{"rules":[{"key":"temperature","operator":">","threshold":40.0,"message":"Warm"},'
    '{"key":"temperature","operator":"<","threshold":5.0,"message":"Cold"}]}',
    4: '{"rules":[{"key":"temperature","operator":"!=","threshold":0,"message":"Never"},'
    '{"key":"k","operator":">=","threshold":90,"message":"High k"}]}',
}
CHANGED_JSON = '{"rules":[{"key":"temperature","operator":">","threshold":50,"message":"Hot"}]}'
BROKEN_JSON = '{"rules":[{"key":"temperature","operator":">","threshold":"50","message":"Hot"}]}'


# Plans, not data, are kept: building one takes thousands of calls into the JVM.
plan_once = lru_cache(maxsize=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@plan_once
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("user_number"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "events").select(F.col("user_id").alias("user_number"))
    return numbers.distinct()


def user_name(number: str = "user_number") -> Column:
    return F.concat(F.lit("user_"), F.col(number).cast("string"))


def _fault() -> Column:
    n = F.col("event_id")
    return (
        F.when(n % 101 == 0, "no_topic")
        .when(n % 97 == 0, "truncated")
        .when(n % 79 == 0, "text_temperature")
        .when(n % 83 == 0, "no_sequence")
        .when(n % 89 == 0, "no_device")
    )


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _payload() -> Column:
    """JSON text of a reading with its keys in order."""
    fault = F.coalesce("fault", F.lit("none"))
    temperature = F.col("value").cast("string")
    return F.concat(
        F.lit('{"battery":'),
        F.col("k").cast("string"),
        F.lit(',"device_id":"'),
        F.when(fault == "no_device", F.lit("")).otherwise(F.col("event_type")),
        F.lit('","ingest_timestamp":'),
        F.unix_millis("ts").cast("string"),
        F.lit(',"k":'),
        F.col("k").cast("string"),
        F.when(fault == "no_sequence", F.lit("")).otherwise(
            F.concat(F.lit(',"sequence_id":'), F.col("event_id").cast("string"))
        ),
        F.lit(',"temperature":'),
        F.when(
            fault == "text_temperature", F.concat(F.lit('"'), temperature, F.lit('"'))
        ).otherwise(temperature),
        F.lit(',"time":"'),
        iso(F.col("ts")),
        F.lit('"}'),
    )


@plan_once
def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device messages before the bridge: ``event_id, ts, topic, message, fault``."""
    text = computed_once(events(spark, sf_dir).withColumn("fault", _fault()), text=_payload())
    text = text.withColumn(
        "topic",
        F.concat(
            F.lit("users/"),
            user_name(),
            F.lit("/devices/"),
            F.col("event_type"),
            F.lit("/telemetry"),
        ),
    )
    cut = F.substring("text", F.lit(1), F.length("text") - 10)
    return text.select(
        "event_id",
        "ts",
        "topic",
        F.when(F.col("fault") == "truncated", cut).otherwise(F.col("text")).alias("message"),
        "fault",
    )


def trace_parent(n: Column) -> Column:
    digits = F.lower(F.hex(n))
    return F.concat(
        F.lit("00-"), F.lpad(digits, 32, "0"), F.lit("-"), F.lpad(digits, 16, "0"), F.lit("-01")
    )


@plan_once
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message stream rows with the telemetry in envelopes; ``timestamp`` is the arrival time."""
    n = F.col("event_id")
    body = F.when(F.col("fault") == "truncated", quoted(F.col("message"))).otherwise(
        F.col("message")
    )
    envelope = F.when(
        F.col("fault") == "no_topic", F.concat(F.lit('{"payload":'), body, F.lit("}"))
    ).otherwise(
        F.concat(
            F.lit('{"payload":'), body, F.lit(',"topic":'), quoted(F.col("topic")), F.lit("}")
        )
    )
    header = F.struct(
        F.lit("traceparent").alias("key"), trace_parent(n).cast("binary").alias("value")
    )
    rows = computed_once(raw_messages(spark, sf_dir), value=envelope.cast("binary"))
    return rows.select(
        F.lit(None).cast("binary").alias("key"),
        "value",
        F.lit(STREAM).alias("topic"),
        (n % PARTITIONS).cast("int").alias("partition"),
        F.floor(n / PARTITIONS).cast("bigint").alias("offset"),
        F.timestamp_micros(F.unix_micros("ts") + (n % 500) * 1000).alias("timestamp"),
        F.when(n % 7 != 0, F.array(header)).alias("headers"),
    )


@plan_once
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_envelope(message_rows(spark, sf_dir))


@plan_once
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_telemetry(decoded(spark, sf_dir))


@plan_once
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_accept_reject(readings(spark, sf_dir))[0]


@plan_once
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_accept_reject(readings(spark, sf_dir))[1]


def with_copies(rows: DataFrame) -> DataFrame:
    """The rows, and for every tenth sequence number a later copy with another temperature."""
    # one pass: a union would decode and parse every message twice
    copies = F.when(F.col("sequence_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both, late = rows.select("*", F.explode(copies).alias("_late")), F.col("_late") == 1
    return both.withColumns(
        {
            "temperature": F.when(late, F.col("temperature") + 1).otherwise(F.col("temperature")),
            "offset": F.when(late, F.col("offset") + 1_000_000_000).otherwise(F.col("offset")),
        }
    ).drop("_late")


@plan_once
def config_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule updates of every user: ``topic, payload, ts, sequence_id``."""
    group = F.col("user_number") % 5
    text = F.lit(None).cast("string")
    for number, payload in RULES_JSON.items():
        text = F.when(group == number, F.lit(payload)).otherwise(text)

    def sent(kind: str, payload: Column, at: str, sequence: int) -> Column:
        topic = {"own": "/config", "foreign": "/settings/config"}[kind]
        return F.struct(
            F.concat(F.lit("users/"), user_name(), F.lit(topic)).alias("topic"),
            payload.alias("payload"),
            F.lit(at).cast("timestamp").alias("ts"),
            F.lit(sequence).cast("bigint").alias("sequence_id"),
        )

    everything = F.array(
        F.when(group != 0, sent("own", text, CONFIG_AT, 0)),
        F.when(group == 2, sent("own", F.lit(CHANGED_JSON), CHANGE_AT, 1)),
        F.when(F.col("user_number") % 11 == 3, sent("own", F.lit(BROKEN_JSON), CHANGE_AT, 2)),
        F.when(F.col("user_number") % 7 == 1, sent("foreign", F.lit("{}"), CHANGE_AT, 3)),
    )
    return users(spark, sf_dir).select(F.inline(F.filter(everything, lambda m: m.isNotNull())))


@plan_once
def command_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert commands: ``topic, payload, ts, sequence_id``."""
    turn = F.col("event_id") % 50
    action = F.when(turn == 7, "SNOOZE").when(turn == 9, "DISABLE").when(turn == 11, "snooze")
    duration = F.when(
        F.col("k") % 2 == 1,
        F.concat(F.lit('"duration_minutes":'), F.col("k").cast("string"), F.lit(",")),
    ).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('{"action":"'),
        action,
        F.lit('","device_id":"'),
        F.col("event_type"),
        F.lit('",'),
        duration,
        F.lit('"rule_id":"temperature"}'),
    )
    return (
        events(spark, sf_dir)
        .where((F.col("event_type") == "error") & turn.isin(7, 9, 11))
        .select(
            F.concat(F.lit("users/"), user_name(), F.lit("/alerts/manage")).alias("topic"),
            payload.alias("payload"),
            "ts",
            F.col("event_id").alias("sequence_id"),
        )
    )


@plan_once
def control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_messages(spark, sf_dir).unionByName(command_messages(spark, sf_dir))


def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages as message stream rows that arrive at their own time."""
    body = F.concat(
        F.lit('{"payload":'), F.col("payload"), F.lit(',"topic":'), quoted(F.col("topic")), F.lit("}")
    )
    header = "array<struct<key:string,value:binary>>"
    return control_messages(spark, sf_dir).select(
        F.lit(None).cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.lit(CONTROL).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("sequence_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast(header).alias("headers"),
    )


def by_minute(rows: DataFrame) -> DataFrame:
    """Message rows that all arrive at full minutes: many at one time, from all partitions."""
    return rows.withColumn("timestamp", F.date_trunc("minute", "timestamp"))


# Rules that must find nothing, beside one that reads a nested number.
MALFORMED_KEYS = ["$.o[", "$.o..p", "$.o['p", "$.o.", "$.o[x]", "$.o[99999999999]", "$.o. ", "$", "$.", ""]
NESTED_KEY = "$.o.p"


@plan_once
def hostile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows that try to stop a query: numbers out of range, malformed rules, endless snoozes."""
    rule = '{"key":"%s","operator":">=","threshold":%s,"message":"m"}'
    listed = ",".join(rule % (key, 0) for key in MALFORMED_KEYS) + "," + rule % (NESTED_KEY, 90)
    endless = F.when(F.col("k") % 2 == 1, F.lit("9223372036854775807")).otherwise(F.lit("-9223372036854775808"))
    n, k = F.col("event_id"), F.col("k").cast("string")
    reading = F.concat(
        F.lit('{"device_id":"'), F.col("event_type"), F.lit('","o":{"p":'), k, F.lit('},"sequence_id":'),
        n.cast("string"),
        F.when(n % 5 == 0, F.lit(',"temperature":1e999')).when(n % 5 == 1, F.lit(',"x":[-1e400]')).otherwise(F.lit("")),
        F.lit(',"time":"'), iso(F.col("ts")), F.lit('"}'),
    )
    command = F.concat(
        F.lit('{"action":"SNOOZE","device_id":"'), F.col("event_type"), F.lit('","duration_minutes":'),
        endless, F.lit(f',"rule_id":"{NESTED_KEY}"}}'),
    )
    user = F.concat(F.lit("users/"), user_name())
    broken = F.lit('{"rules":[{"key":"o","operator":">","threshold":1e999,"message":"m"}]}')

    def sent(topic: str, payload: Column, source: str) -> Column:
        return F.struct(F.concat(user, F.lit(topic)).alias("to"), payload.alias("body"), F.lit(source).alias("topic"))

    everything = F.array(
        sent("/telemetry", reading, STREAM),
        F.when((F.col("event_type") == "error") & (n % 50 == 7), sent("/alerts/manage", command, CONTROL)),
    )
    messages = events(spark, sf_dir).select("ts", "event_id", F.inline(F.filter(everything, lambda m: m.isNotNull())))
    early = F.lit(CONFIG_AT).cast("timestamp")
    orders = F.array(sent("/config", F.lit(f'{{"rules":[{listed}]}}'), CONTROL), sent("/config", broken, CONTROL))
    configs = users(spark, sf_dir).select(early.alias("ts"), F.col("user_number").alias("event_id"), F.inline(orders))
    # as text, a payload out of range fails by itself; as JSON, the envelope around it does
    as_text = (F.col("topic") == STREAM) & (F.col("event_id") % 5 == 0)
    body = F.when(as_text, quoted(F.col("body"))).otherwise(F.col("body"))
    value = F.concat(F.lit('{"topic":'), quoted(F.col("to")), F.lit(',"payload":'), body, F.lit("}"))
    return messages.unionByName(configs).select(
        F.lit(None).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


#: Another domain: parcels with a status and a price.
DELIVERY = DomainSpec(
    fields=(
        Field("time", "timestamp", required=True),
        Field("package_id", "string", required=True, non_empty=True),
        Field("status", "string", required=True),
        Field("price", "double", required=True),
    ),
    key=("time", "package_id"),
    time="time",
    topic_filter="users/+/packages/+",
)


def delivery_payload() -> Column:
    """Payload of an order as a delivery."""
    return F.to_json(
        F.struct(
            iso(F.col("o_orderdate").cast("timestamp")).alias("time"),
            F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("package_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"),
        )
    )


def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as message rows: every seventh comes twice, every eleventh has no price, some other topics."""
    n = F.col("o_orderkey")
    payload = F.when(n % 11 == 0, F.regexp_replace(delivery_payload(), ',"price":[^}]*', "")).otherwise(delivery_payload())
    place = F.when(n % 13 == 0, "elsewhere").otherwise("packages")
    topic = F.concat(F.lit("users/u"), n % 5, F.lit("/"), place, F.lit("/p"), n)
    value = F.concat(F.lit('{"payload":'), payload, F.lit(',"topic":"'), topic, F.lit('"}'))
    change = F.lit(CHANGE_AT).cast("timestamp")
    when = F.when(n % 2 == 0, change).otherwise(change - F.expr("INTERVAL 1 DAY"))
    rows = table(spark, sf_dir, "orders").select(
        F.lit(None).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("deliveries").alias("topic"),
        F.lit(0).alias("partition"),
        n.cast("long").alias("offset"),
        when.alias("timestamp"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )
    later = rows.where(F.col("offset") % 7 == 0).withColumns({"offset": F.col("offset") + 10**9, "timestamp": change})
    return rows.unionByName(later)


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type that climbs with the event id and falls back every 1000 events."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"),
        "ts",
        ((F.col("event_id") % 1000) * 3 + F.col("k")).cast("double").alias("value"),
    )


@plan_once
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish attempts; every thirteenth goes to another user's topic."""
    n = F.col("event_id")
    owner = F.when(n % 13 == 0, F.col("user_number") + 1).otherwise(F.col("user_number"))
    return events(spark, sf_dir).select(
        "event_id",
        F.when(n % 17 == 0, F.lit("backend_service")).otherwise(user_name()).alias("username"),
        F.when(n % 19 != 0, F.col("event_type")).alias("clientid"),
        F.when(n % 5 == 0, F.lit("subscribe")).otherwise(F.lit("publish")).alias("action"),
        F.concat(
            F.lit("users/user_"),
            owner.cast("string"),
            F.when(n % 5 == 0, F.lit("/config"))
            .when(n % 17 == 0, F.lit("/alerts"))
            .otherwise(F.concat(F.lit("/devices/"), F.col("event_type"), F.lit("/telemetry"))),
        ).alias("topic"),
    )


def access_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General rows, some of them denials, and a row per third user that opens a neighbour's topics.

    Rows count in order of ``id``: the service's row goes before the denial of all alerts, and the
    denial of user_3's topics before the rows that open them.
    """
    general = spark.createDataFrame(
        [
            (0, "$all", "publish", "users/user_3/#", "deny"),
            (1, "$all", "publish", "users/%u/devices/%c/telemetry", None),
            (2, "$all", "subscribe", "users/%u/config", "allow"),
            (3, "backend_service", "publish", "users/+/alerts", "allow"),
            (4, "$all", "all", "users/+/alerts", "deny"),
        ],
        "id long, username string, permission string, topic string, action string",
    )
    own = users(spark, sf_dir).where(F.col("user_number") % 3 == 0).select(
        user_name().alias("username"),
        F.lit("all").alias("permission"),
        F.concat(
            F.lit("users/user_"), (F.col("user_number") + 1).cast("string"), F.lit("/#")
        ).alias("topic"),
        F.lit("allow").alias("action"),
        F.lit(10).cast("long").alias("id"),
    )
    return general.unionByName(own)


def hot_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings; a third of them belongs to one device."""
    hot = F.col("l_orderkey") % 3 == 0
    user = F.when(hot, "hot").otherwise(F.concat(F.lit("user_"), F.col("l_suppkey") % 7))
    device = F.when(hot, "hot").otherwise((F.col("l_partkey") % 50).cast("string"))
    return _line_items(table(spark, sf_dir, "lineitem"), user, device)


def hot_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as readings and orders as rule changes; one user has a third of both."""

    def user(number, other):
        return F.when(F.col(number) % 3 == 0, "hot").otherwise(F.concat(F.lit("user_"), F.col(other) % 7))

    readings = table(spark, sf_dir, "lineitem").select(
        user("l_orderkey", "l_suppkey").alias("rule_user"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence_id"),
    )
    rule = F.struct(
        F.lit("temperature").alias("key"),
        F.lit(">").alias("operator"),
        F.col("o_totalprice").cast("double").alias("threshold"),
        F.lit("m").alias("message"),
    )
    changes = table(spark, sf_dir, "orders").where(F.col("o_custkey") % 7 != 5).select(
        user("o_orderkey", "o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("time"),
        F.col("o_orderkey").cast("long").alias("sequence_id"),
        F.array(rule).alias("rules"),
    )
    return readings, changes


def lineitem_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger input for timing: line items as readings of (supplier, part)."""
    user = F.concat(F.lit("user_"), F.col("l_suppkey").cast("string"))
    return _line_items(table(spark, sf_dir, "lineitem"), user, F.col("l_partkey").cast("string"))


def _line_items(rows: DataFrame, user: Column, device: Column) -> DataFrame:
    return rows.select(
        user.alias("user_id"),
        device.alias("device_id"),
        F.lit("temperature").alias("rule_id"),
        F.lit(0).alias("pos"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence_id"),
        F.col("l_quantity").cast("double").alias("value"),
        F.lit("Large quantity").alias("message"),
        (F.col("l_quantity") > 25).alias("triggered"),
    )
