"""Alerts as keyed state: rules per user, alerts per user and (device, rule), in RocksDB state stores.

An alternative to ``live.start_alerts``. There, each micro-batch rewrites snapshot buckets; here, it
touches only the keys that it has rows for, and the state lies with the checkpoint. The price is that the
rows of one user are one task's work, so a user with most of the messages belongs to the snapshot form.
Both give the same history.

The first operator keeps the rules of a user and hands them to each later reading. Evaluating them is
JVM work without state. The second operator keeps the alerts of a user, each under its device and rule:
Spark sends every key's rows and results as messages of their own, so few keys cost less than one per alert.
Rows are sorted by arrival first, as a micro-batch brings them in any order; rows of one user and batch are
held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pulsegrid.functions.strict_json import members, parse_document
from pulsegrid.functions.topics import control_route, maybe_control
from pulsegrid.operators import alerts, control, parse, rules
from pulsegrid.operators.envelope import decode_envelope
from pulsegrid.schemas import ACTIVE_ALERT, ALERT_KEYS
from pulsegrid.session import configure
from pulsegrid.sources.tables import append_batch
from pulsegrid.streaming.live import SEQUENCE, Store, arrival, start

NAME = "alerts_keyed"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Columns that say when a message arrived, in the order in which they count.
PLACE_COLUMNS = ["clock", "source_topic", "partition", "offset"]
PLACE = "clock long, source_topic string, partition int, offset long"
READING = "user_id string, device_id string, time long, temperature double, battery int, extra_data string"
RULED = f"{PLACE}, rules string, reading string"
KEPT_ALERT = "status string, start_time long, last_seen long, current_value double, snooze_until long"
ALERT_OF_USER = "device_id string, rule_id string"
KEPT_COLUMNS = [column.split()[0] for column in KEPT_ALERT.split(", ")]
FOLLOWED = "user_id string, device_id string, rule_id string, time long, value double, message string, status string"


def _picked(rows: Iterator[Row], names: list[str]) -> Iterator[tuple]:
    """Plain tuples of some columns; a Row looks a name up at every access."""
    pick = None
    for row in rows:
        if pick is None:
            pick = itemgetter(*[row.__fields__.index(n) for n in names])
        yield pick(tuple(row))


class RulesOfUser(StatefulProcessor):
    """Keeps a user's rules (JSON text) and adds them to every reading that comes after them."""

    def init(self, handle) -> None:
        self.rules = handle.getValueState("rules", "rules string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.rules.get()
        current = before = known[0] if known else None
        ruled = Row(*PLACE_COLUMNS, "rules", "reading")
        places = itemgetter(slice(len(PLACE_COLUMNS)))
        for row in sorted(_picked(rows, [*PLACE_COLUMNS, "rules", "reading"]), key=places):
            *place, rules_, reading = row
            if reading is None:
                current = rules_
            else:
                yield ruled(*place, current, reading)
        if current != before:
            self.rules.update((current,))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.rules.update((initialState.rules,))

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Alert:
    """One existing alert; times in microseconds."""

    status: str
    start_time: int | None
    last_seen: int | None
    current_value: float | None
    snooze_until: int | None


def evaluated(alert: Alert | None, holds: bool, time: int, value: float, clock: int) -> tuple[Alert | None, str | None]:
    """Alert and emitted status after an evaluation that arrives at ``clock``."""
    if not holds:
        return (alert, None) if alert is None or alert.status == "Disabled" else (None, "Resolved")
    if alert is None:
        return Alert("Active", time, time, value, None), "Triggered"
    alert = replace(alert, last_seen=time, current_value=value)
    if alert.status == "Snoozed" and alert.snooze_until is not None and alert.snooze_until < clock:
        return replace(alert, status="Active", snooze_until=None), "Triggered"
    return alert, None


def commanded(alert: Alert | None, action: str, until: int | None) -> Alert | None:
    """Alert after a command; a command to no alert does nothing."""
    if alert is None:
        return None
    if action == "SNOOZE":
        return replace(alert, status="Snoozed", snooze_until=until)
    return replace(alert, status="Disabled", snooze_until=None)


class AlertsOfUser(StatefulProcessor):
    """Keeps a user's alerts by device and rule, and emits what evaluations make of them."""

    def init(self, handle) -> None:
        self.alerts = handle.getMapState("alerts", ALERT_OF_USER, KEPT_ALERT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        order = [*PLACE_COLUMNS, "kind", "pos"]
        names = ["device_id", "rule_id", *order, "time", "value", "message", "triggered", "action", "until"]
        inputs: dict[tuple, list[tuple]] = {}
        for row in _picked(rows, names):
            inputs.setdefault(row[:2], []).append(row[2:])
        followed_ = Row(*ALERT_KEYS, "time", "value", "message", "status")
        for name, steps in inputs.items():
            known = self.alerts.getValue(name)
            alert = before = Alert(*known) if known else None
            for row in sorted(steps, key=itemgetter(slice(len(order)))):
                time, value, message, triggered, action, until = row[len(order) :]
                if action is not None:
                    alert = commanded(alert, action, until)
                    continue
                alert, status = evaluated(alert, triggered, time, value, row[0])
                if status is not None:
                    yield followed_(*key, *name, time, value, message, status)
            if alert is None:
                if before is not None:
                    self.alerts.removeKey(name)
            elif alert != before:
                kept = (alert.status, alert.start_time, alert.last_seen, alert.current_value, alert.snooze_until)
                self.alerts.updateValue(name, kept)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        name, kept = (tuple(initialState[c] for c in names) for names in (ALERT_KEYS[1:], KEPT_COLUMNS))
        self.alerts.updateValue(name, kept)

    def close(self) -> None:
        pass


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _place(sequence: str = "sequence_id") -> list:
    return [F.col(f"{sequence}.{c}").alias(c) for c in PLACE_COLUMNS[1:]]


def _opened(messages: DataFrame) -> DataFrame:
    return arrival(decode_envelope(messages).withColumn("route", control_route(F.col("topic"))))


def _with_rules(decoded: DataFrame, orders: DataFrame, configs: DataFrame) -> DataFrame:
    """Readings of users, in the columns that ``evaluate_rules`` needs, with the rules of their time."""
    updates = control.parse_config_update(orders).where(F.col("error").isNull())
    telemetry = decoded.where(F.col("route").isNull()).withColumnRenamed("sequence_id", "place")
    readings = parse.parse_telemetry(telemetry).where("error IS NULL AND rule_user IS NOT NULL")
    reading = F.struct("user_id", "device_id", F.unix_micros("time").alias("time"), "temperature", "battery", "extra_data")
    clock = F.unix_micros("timestamp").alias("clock")
    inputs = updates.select(
        F.col("user_id").alias("rule_user"), clock, *_place(), F.to_json("rules").alias("rules"),
        F.lit(None).cast("string").alias("reading"),
    ).unionByName(
        readings.select("rule_user", clock, *_place("place"), F.lit(None).cast("string").alias("rules"), F.to_json(reading).alias("reading"))
    )
    known = configs.select(F.col("user_id").alias("rule_user"), F.to_json("rules").alias("rules"))
    ruled = inputs.groupBy("rule_user").transformWithState(
        RulesOfUser(), _schema(RULED), "append", "none", initialState=known.groupBy("rule_user")
    )
    opened = ruled.select(
        F.timestamp_micros("clock").alias("timestamp"),
        F.struct("source_topic", "partition", "offset").cast(SEQUENCE).alias("sequence_id"),
        F.coalesce(F.from_json("rules", rules.RULE_TYPE), rules.default_rules()).alias("rules"),
        F.from_json("reading", READING).alias("r"),
    )
    return opened.select(
        "timestamp", "sequence_id", "rules", "r.user_id", "r.device_id", F.timestamp_micros("r.time").alias("time"),
        "r.temperature", "r.battery", members(parse_document(F.col("r.extra_data"))).alias("extras"),
    )


def followed(messages: DataFrame, configs: DataFrame, active: DataFrame) -> DataFrame:
    """Stream of alert rows; ``configs`` and ``active`` are where a new checkpoint starts from."""
    # each kind reads the stream; those of the control channel open no message that cannot be on it
    orders = _opened(messages.where(maybe_control(F.col("value").cast("string"))))
    evaluations = rules.evaluate_rules(_with_rules(_opened(messages), orders, configs), carry=("timestamp",))
    commands = control.parse_command(orders).where(F.col("error").isNull())
    inputs = alerts.inputs(evaluations, commands, "timestamp").select(
        *ALERT_KEYS, F.unix_micros("clock").alias("clock"), *_place(), "kind", "pos", F.unix_micros("time").alias("time"),
        "value", "message", "triggered", "action", F.unix_micros("until").alias("until"),
    )
    times = ("start_time", "last_seen", "snooze_until")
    known = active.withColumns({c: F.unix_micros(c) for c in times})
    known = known.select(*ALERT_KEYS, *KEPT_COLUMNS)
    changes = inputs.groupBy("user_id").transformWithState(
        AlertsOfUser(), _schema(FOLLOWED), "append", "none", initialState=known.groupBy("user_id")
    )
    return alerts.make_alert(changes.withColumn("time", F.timestamp_micros("time")))


def start_keyed_alerts(
    messages: DataFrame,
    store: Store,
    configs: DataFrame | None = None,
    active: DataFrame | None = None,
    publish: Callable[[DataFrame], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Follow alerts in keyed state; the history goes where ``live.start_alerts`` puts it.

    A new checkpoint starts from ``configs`` (user_id, rules) and ``active`` alerts, by default the
    newest snapshots of the store; ``kept_rules`` and ``kept_alerts`` read them from another checkpoint.
    An existing checkpoint goes on from its own state.
    """
    spark = configure(messages.sparkSession)
    configs = store.configs(spark).latest() if configs is None else configs
    active = store.active(spark).latest() if active is None else active

    def batch(rows: DataFrame, query: str, batch_id: int) -> None:
        history = rows.withColumn("created_at", F.current_timestamp())
        append_batch(history, store.history, query, batch_id)
        if publish is not None:
            publish(alerts.publish_alerts(history))

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        # a query keeps the settings it was started with
        return start(followed(messages, configs, active), batch, store.checkpoint(NAME), trigger)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _kept(spark: SparkSession, store: Store, variable: str, operator: int, *parts: str) -> DataFrame:
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    return reader.load(store.checkpoint(NAME)).select(*[f"{part}.*" for part in parts])


def kept_rules(spark: SparkSession, store: Store) -> DataFrame:
    """Rules per user as a stopped query left them."""
    kept = _kept(spark, store, "rules", 1, "key", "value")
    return kept.select(F.col("rule_user").alias("user_id"), F.from_json("rules", rules.RULE_TYPE).alias("rules"))


def kept_alerts(spark: SparkSession, store: Store) -> DataFrame:
    """Alerts as a stopped query left them."""
    kept = _kept(spark, store, "alerts", 0, "key", "user_map_key", "user_map_value")
    columns = {f.name: F.timestamp_micros(f.name) for f in ACTIVE_ALERT if isinstance(f.dataType, T.TimestampType)}
    return kept.withColumns(columns).select(*ACTIVE_ALERT.names)
